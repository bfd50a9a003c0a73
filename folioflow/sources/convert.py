"""Books of other formats, made into EPUBs and back by an external converter.

The converter is a program that every executor has. A book's bytes come as a
row and go as one, so books may be in any store; files are written only to the
scratch folder of the task that runs the program, which goes with it.
"""

from __future__ import annotations

import os
import shutil
import signal
import subprocess
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# The program, where it is looked for beside the path, and how much of what it says is told.
PROGRAM = "ebook-convert"
PLACES = ("/usr/bin/ebook-convert", "/usr/local/bin/ebook-convert", "~/.local/bin/ebook-convert", "/Applications/calibre.app/Contents/MacOS/ebook-convert")
SECONDS, TOLD_CHARACTERS = 300.0, 2000

#: Formats that an EPUB can be made into.
OUTPUTS = ("epub", "mobi", "azw3")


class ConvertError(ValueError):
    pass


def find_converter(custom: str = "") -> str:
    """The program: the file or the name on the path that is set, else where it usually is."""
    if custom:
        named = custom if os.path.isfile(custom) else shutil.which(custom) if os.path.basename(custom) == custom else None
        if named is None:
            raise ConvertError(f"there is no converter {custom}")
        return named
    found = shutil.which(PROGRAM) or next((p for p in map(os.path.expanduser, PLACES) if os.path.isfile(p)), None)
    if found is None:
        raise ConvertError(f"{PROGRAM} isn't installed: set ebook_convert_path, or give EPUB books")
    return found


def run_converter(program: str, source: str, made: str, encoding: str = "", seconds: float = SECONDS) -> None:
    """One file into another. The program has a process group of its own, which ends with it or with its time."""
    command = [program, source, made, *(["--input-encoding", encoding] if encoding else [])]
    with tempfile.TemporaryFile() as said:
        process = subprocess.Popen(command, stdin=subprocess.DEVNULL, stdout=subprocess.DEVNULL, stderr=said, start_new_session=True)
        try:
            code = process.wait(seconds)
        except BaseException as e:
            os.killpg(process.pid, signal.SIGKILL)
            process.wait()
            if isinstance(e, subprocess.TimeoutExpired):
                raise ConvertError(f"the converter took over {seconds:g} seconds") from e
            raise
        said.seek(0)
        if code:
            raise ConvertError(f"the converter failed ({code}): {said.read().decode(errors='replace')[-TOLD_CHARACTERS:]}")
    if not os.path.isfile(made):
        raise ConvertError("the converter wrote no file")


def convert_books(files: DataFrame, to: str = "epub", converter: str = "", encoding: str = "", seconds: float = SECONDS) -> DataFrame:
    """files(path, content) as (path, content, error): each in the format `to`, or what went wrong.

    A file that is in this format already passes by. Store the rows before they
    are read more than once, as each reading converts again.
    """

    def one(path: str, data: bytes) -> bytes:
        kind = os.path.splitext(path)[1].lower()
        if kind == f".{to}":
            return data
        with tempfile.TemporaryDirectory(prefix="folioflow-convert-") as scratch:
            source, made = os.path.join(scratch, f"input{kind}"), os.path.join(scratch, f"output.{to}")
            with open(source, "wb") as f:
                f.write(data)
            run_converter(find_converter(converter), source, made, encoding, seconds)
            with open(made, "rb") as f:
                return f.read()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    row = (path, one(path, bytes(data)), None)
                except (ConvertError, OSError) as e:
                    row = (path, None, str(e))
                yield pd.DataFrame([row], columns=["path", "content", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, content binary, error string")
