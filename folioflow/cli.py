"""The command line: one book or a folder of them, with settings over those of a file.

Exit codes: 0 if all went well, 1 if a book or the settings failed, 130 if
interrupted (what is done is stored).
"""

from __future__ import annotations

import argparse
import logging
import os
import sys
import time

from pyspark.sql import SparkSession

from .config import CONCURRENCY_MOST, ENGINES, Config, ConfigError
from .job import Job
from .operators.translate import Engine
from .sources import convert

log = logging.getLogger("folioflow")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="folioflow", description="Translates books.")
    p.add_argument("input", help="a book, or a folder of books")
    p.add_argument("output", nargs="?", help="the folder to write to")
    p.add_argument("-o", "--output-format", choices=convert.OUTPUTS, default="epub")
    p.add_argument("-c", "--config", help="a file of settings")
    p.add_argument("-e", "--engine", choices=ENGINES)
    p.add_argument("-s", "--source-lang")
    p.add_argument("-t", "--target-lang")
    p.add_argument("--target-lang-code", help="language tag of the translation")
    p.add_argument("--target-direction", choices=("auto", "ltr", "rtl"))
    p.add_argument("--concurrency", type=int, help="requests at a time")
    p.add_argument("-f", "--force", action="store_true", help="replace outputs that exist")
    p.add_argument("--no-cache", action="store_true", help="keep no checkpoint")
    p.add_argument("--skip-failed", action="store_true", help="write books with units that failed")
    p.add_argument("--log-file")
    p.add_argument("--dry-run", action="store_true", help="only tell which books there are")
    p.add_argument("--test", action="store_true", help="only the first units")
    p.add_argument("--test-num", type=int, help="how many of them")
    p.add_argument("--retranslate-file", help="page of a range to do again")
    p.add_argument("--retranslate-start", help="text that the range begins with")
    p.add_argument("--retranslate-end", help="text that it ends with")
    p.add_argument("--translate-metadata", action="store_true")
    p.add_argument("--translate-title", action="store_true", help="translate titles, for file names too")
    p.add_argument("--custom-title", help="title of the one book")
    p.add_argument("--input-encoding", help="for the converter")
    p.add_argument("--review-export", help="write a review file, and nothing else")
    p.add_argument("--review-import", help="take a review file's decisions")
    p.add_argument("--retranslate-all", action="store_true")
    return p


def settings(args: argparse.Namespace) -> Config:
    """The settings file's, with those of the call over them; a number of 0 and a switch that isn't set leave one as it is."""
    told = {k: getattr(args, k) for k in ("target_lang_code", "target_direction", "log_file", "retranslate_file", "retranslate_start", "retranslate_end", "custom_title", "input_encoding")}
    told |= {k: getattr(args, k) for k in ("engine", "source_lang", "target_lang")}
    told |= {"cache_enabled": False if args.no_cache else None, "skip_failed": args.skip_failed or None, "test_enabled": args.test or None, "test_num": args.test_num or None}
    told |= {"metadata_translation": args.translate_metadata or None, "translate_title": args.translate_title or None}
    config = Config.load(args.config).override(**told)
    if args.concurrency:
        if not 0 < args.concurrency <= CONCURRENCY_MOST:
            raise ConfigError(f"concurrency must be 1 to {CONCURRENCY_MOST}")
        config = config.with_concurrency(args.concurrency)
    return config.validate()


def log_to(path: str) -> logging.Handler | None:
    """Lines `seconds [LEVEL] message` at the end of a file; none without a path."""
    if not path:
        return None
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    handler = logging.FileHandler(path, encoding="utf-8")
    handler.setFormatter(logging.Formatter("%(created)d [%(levelname)s] %(message)s"))
    log.addHandler(handler)
    log.setLevel(logging.INFO)
    return handler


def main(argv: list[str] | None = None, spark: SparkSession | None = None, engines: list[Engine] | None = None) -> int:
    args = parser().parse_args(argv)
    handler, job, began = None, None, time.time()
    try:
        config = settings(args)
        handler = log_to(config.log_file)
        log.info("started")
        # a task that runs twice would ask twice
        spark = spark or SparkSession.builder.appName("folioflow").config("spark.speculation", "false").getOrCreate()
        job = Job(spark, config, engines)
        if args.dry_run:
            for r in job.dry_run(args.input).collect():
                print(f"{os.path.basename(r.path)}  ({r.size})")
            return 0
        done, code = job.run_all(args.input, args.output, args.force, args.output_format, args.review_export, args.review_import, args.retranslate_all)
        good = sum(o.ok for o in done)
        print(f"{good} done, {len(done) - good} failed, {(time.time() - began) / 60:.1f} minutes", file=sys.stderr)
        return code
    except KeyboardInterrupt:
        print("interrupted; what is done is stored", file=sys.stderr)
        return 130
    except (ConfigError, convert.ConvertError, OSError) as e:
        log.error("%s", e)
        print(f"error: {e}", file=sys.stderr)
        return 1
    finally:
        if job is not None:
            job.close()
        if handler is not None:
            log.removeHandler(handler)
            handler.close()


if __name__ == "__main__":
    sys.exit(main())
