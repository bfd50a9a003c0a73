"""Operator 7: line dedup by a log-template tree, in DataFrame functions only.

A line's words with digits become "<*>", and white space one space; a line
without a letter elsewhere is told apart by its numbers. Lines then go down a
tree of fixed depth: by their number of words, then by their first three words.
In a leaf of at least `leaf_lines` different lines, each place where one word
holds over half of them keeps that word, any other becomes "<*>"; if three
quarters of the places keep their word, a place behind the first three keeps
one with a letter, and there are four words at least, the lines that agree with
all of these have that template. Any other line is its own template.

A template recurs if it stands in `min_texts` different texts and, to tell
boilerplate from the lines of edited copies, if enough of them are texts of
their own (`independent`). Lines of recurring templates are dropped from all
documents. Exact copies of a text count once.

Blank lines are kept. A null text is an empty one and comes back as ''; so
does a text of which all lines go. Repeated rows get equal results, null ids
come back, an empty table gives no rows. Templates are told apart by 64 bits
of each of two hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WILD = "<*>"
SPACES = r"[ \t\r\x0B\f]+"
LETTER = r"\p{L}"
#: A line that masking leaves as it is: it begins with a letter, has no digit, and its white space is single spaces.
PLAIN = r"^\p{L}[^0-9 \t\r\x0B\f]*+(?: [^0-9 \t\r\x0B\f]++)*+$"
#: First and last three words of a line, of a short one its halves (the first of under four words: all of it), and the three after and before them: an edit changes few of them.
ENDS = {
    "head": "if(words < 4, line, substring_index(line, ' ', least(3, (words + 1) div 2)))",
    "tail": "substring_index(line, ' ', -least(3, words div 2))",
    "second": "if(words < 6, null, substring_index(substring_index(line, ' ', 6), ' ', -3))",
    "last_but_one": "if(words < 6, null, substring_index(substring_index(line, ' ', -6), ' ', 3))",
}


def masked(line: Column) -> Column:
    """The line with variable words generalised and white space made one; without a letter then, with white space made one."""
    numbers = F.trim(F.regexp_replace(F.regexp_replace(line, r"(?<![^ \t\r\x0B\f])[^ \t\r\x0B\f0-9]*+[0-9][^ \t\r\x0B\f]*+", WILD), SPACES, " "))
    return F.when(line.rlike(PLAIN), line).when(numbers.rlike(LETTER), numbers).otherwise(F.trim(F.regexp_replace(line, SPACES, " ")))


def lead(line: Column) -> Column:
    return F.substring_index(line, " ", 3)


def _two(c: Column) -> list[Column]:
    """Two hashes of a template's text."""
    return [F.xxhash64(c).alias("t1"), F.xxhash64(F.lit("template"), c).alias("t2")]


def lines_of(docs: DataFrame) -> DataFrame:
    """(k1, k2, pos, line, words, leaf) of the lines with words, masked; docs as common.keyed()."""
    # a split has one part at least: `outer` only spares a filter that would split once more
    found = docs.select("k1", "k2", F.posexplode_outer(F.split("text", "\n", -1)).alias("pos", "raw")).filter(F.btrim("raw", F.lit(" \t\r\x0b\f")) != "")
    found = found.select("k1", "k2", "pos", masked(F.col("raw")).alias("line"))
    words = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit("")))
    return found.withColumns({"words": words + 1, "leaf": F.xxhash64(words, lead(F.col("line")))})


def templates(lines: DataFrame, slim: DataFrame, leaf_lines: int) -> DataFrame:
    """(h1, h2, t1, t2): template of the lines that have one other than themselves."""
    crowded = slim.select("leaf", "h1").distinct().groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") >= leaf_lines).select("leaf")
    members = common.cut(common.split_join(lines.select("leaf", "line"), crowded, ["leaf"]).distinct())
    words = members.select("leaf", F.posexplode(F.split("line", " ")).alias("place", "word")).groupBy("leaf", "place", "word").agg(F.count("*").alias("n"))
    most = words.groupBy("leaf", "place").agg(F.max(F.struct("n", "word")).alias("top"), F.sum("n").alias("all"))
    kept = F.when(F.col("top.n") * 2 > F.col("all"), F.col("top.word"))
    pattern = (
        most.groupBy("leaf")
        .agg(F.sort_array(F.collect_list(F.struct("place", kept.alias("word")))).alias("p"))
        .select("leaf", F.transform("p", lambda x: x["word"]).alias("p"))
        .filter("size(p) >= 4 and 4 * size(filter(p, w -> w is not null)) >= 3 * size(p)")
    )
    # the first three words are alike in a leaf and prove nothing
    pattern = pattern.filter(F.exists(F.expr("slice(p, 4, size(p) - 3)"), lambda w: F.coalesce(w.rlike(LETTER), F.lit(False))))
    agrees = F.forall(F.arrays_zip(F.split("line", " ").alias("w"), F.col("p").alias("q")), lambda x: x["q"].isNull() | (x["w"] == x["q"]))
    text = F.array_join(F.transform("p", lambda w: F.coalesce(w, F.lit(WILD))), " ")
    return members.join(pattern, "leaf").filter(agrees).select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("template"), F.col("line")).alias("h2"), *_two(text))


def independent(placed: DataFrame, some: DataFrame, often: DataFrame, min_texts: int) -> DataFrame:
    """(t1, t2) of the templates `often` (in `min_texts` texts) that texts of their own hold, however many copies hold them too.

    A text is its own if a third of its lines at least are in no such template;
    the longest of these tells what the text is about. Texts that begin it
    alike are edits of one text, and so is one that has other words at its
    ends (`ENDS`) in common with these. A template needs `min_texts` texts that
    are alone, and as many as the edited ones, of which a group counts
    `min_texts` at most: longest lines of copies that are edited much vary too.
    """
    marked = placed.join(often.withColumn("shared", F.lit(True)), ["t1", "t2"], "left")
    rest = F.max(F.when(F.col("shared").isNull(), F.struct("size", (-F.col("pos")).alias("place"), *ENDS))).alias("rest")
    own = marked.groupBy("k2").agg(F.count("*").alias("lines"), F.count_if(F.col("shared").isNull()).alias("own"), rest)
    own = own.filter("3 * own >= lines").select("k2", F.col("rest.head").alias("head"), F.array(*(f"rest.{c}" for c in ENDS if c != "head")).alias("ends"))
    # distinct before the join: behind it, the join's partitions would serve, and with them a template that most texts hold is one task
    texts = some.select("t1", "t2", "k2").distinct()
    held = common.cut(common.split_join(texts, often, ["t1", "t2"]).join(own, "k2"))
    heads = held.groupBy("t1", "t2", "head").agg(F.count("*").alias("n"))
    edited = heads.filter("n > 1")
    groups = edited.groupBy("t1", "t2").agg(F.sum(F.least("n", F.lit(min_texts))).alias("edited"))
    ends = held.select("t1", "t2", "head", F.explode("ends").alias("end")).filter("end is not null").distinct()
    known = ends.join(edited, ["t1", "t2", "head"], "left_semi").select("t1", "t2", "end").distinct()
    stale = ends.join(known, ["t1", "t2", "end"], "left_semi").select("t1", "t2", "head")
    alone = heads.filter("n = 1").join(stale, ["t1", "t2", "head"], "left_anti").groupBy("t1", "t2").agg(F.count("*").alias("alone"))
    return alone.filter(F.col("alone") >= min_texts).join(groups, ["t1", "t2"], "left").filter("edited is null or alone >= edited").select("t1", "t2")


def recurring_lines(docs: DataFrame, min_texts: int = 5, leaf_lines: int = 3) -> DataFrame:
    """(k1, k2, drops): sorted places of the lines to drop; docs as common.keyed()."""
    lines = lines_of(docs)
    ends = [F.length("line").alias("size"), *(F.when(F.expr(x) != "", F.hash(F.expr(x))).alias(c) for c, x in ENDS.items())]
    slim = common.cut(lines.select("k1", "k2", "pos", "leaf", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("template"), F.col("line")).alias("h2"), *ends))
    placed = slim.join(templates(lines, slim, leaf_lines), ["h1", "h2"], "left").select("k1", "k2", "pos", F.coalesce("t1", "h1").alias("t1"), F.coalesce("t2", "h2").alias("t2"), "size", *ENDS)
    # plain counts leave few templates to count texts of
    often = placed.groupBy("t1", "t2").agg(F.count("*").alias("n")).filter(F.col("n") >= min_texts).select("t1", "t2")
    some = common.cut(common.split_join(placed.select("k1", "k2", "pos", "t1", "t2"), often, ["t1", "t2"]))
    texts = some.select("t1", "t2", "k2").distinct().groupBy("t1", "t2").agg(F.count("*").alias("texts")).filter(F.col("texts") >= min_texts)
    gone = independent(placed, some, common.cut(texts.select("t1", "t2")), min_texts)
    return common.split_join(some, gone, ["t1", "t2"]).groupBy("k1", "k2").agg(F.sort_array(F.collect_set("pos")).alias("drops"))


def without(text: Column, drops: Column) -> Column:
    """The text without the lines at the sorted places `drops`, put together from the stretches between them."""
    lines = F.split(text, "\n", -1)
    froms = F.concat(F.array(F.lit(-1)), drops)
    tos = F.concat(drops, F.array(F.size(lines)))
    kept = F.zip_with(froms, tos, lambda a, b: F.slice(lines, a + 2, b - a - 1))
    return F.array_join(F.flatten(kept), "\n")


def drop_recurring(docs: DataFrame, min_texts: int = 5, leaf_lines: int = 3) -> DataFrame:
    """docs with the text that is left, n_lines and n_dropped (columns of these names give way)."""
    keys = {"__k1": F.coalesce(F.col("doc_id").cast("long"), F.lit(common.NULL_ID)), "__k2": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))}
    drops = recurring_lines(common.keyed(docs), min_texts, leaf_lines).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("drops").alias("__drops"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.withColumns(keys).join(drops, ["__k1", "__k2"], "left")
    columns = [F.coalesce(F.when(F.col("__drops").isNotNull(), without(text, F.col("__drops"))), text).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*columns, (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"), F.coalesce(F.size("__drops"), F.lit(0)).cast("long").alias("n_dropped"))


def op7_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_recurring(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays, without its recurring lines; n_chars follows the text, other columns stay as they are."""
    held, back = common.aside(docs, ["n_lines", "n_dropped"])
    out = drop_recurring(held)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(back)


OP7_SQL = r"""
WITH split AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS raw FROM documents),
single AS (
  SELECT doc_id, md5(text) AS th, i, raw[i] AS line, trim(regexp_replace(raw[i], '[ \t\r\x0B\f]+', ' ', 'g')) AS one,
    trim(regexp_replace(regexp_replace(raw[i], '[^ \t\r\x0B\f]*[0-9][^ \t\r\x0B\f]*', '<*>', 'g'), '[ \t\r\x0B\f]+', ' ', 'g')) AS numbers
  FROM (SELECT *, unnest(range(1, len(raw) + 1)) AS i FROM split)
), lines AS (
  SELECT doc_id, th, i, line, CASE WHEN regexp_matches(numbers, '\p{L}') THEN numbers ELSE one END AS m FROM single
), placed AS (
  SELECT *, array_to_string(string_split(m, ' ')[1:3], ' ') AS head, len(string_split(m, ' ')) AS n FROM lines
), members AS (
  SELECT DISTINCT n, head, m FROM placed WHERE m <> '' QUALIFY count(DISTINCT m) OVER (PARTITION BY n, head) >= 3
), words AS (
  SELECT n, head, p, w, count(*) AS c FROM (SELECT n, head, unnest(range(1, n + 1)) AS p, unnest(string_split(m, ' ')) AS w FROM members) GROUP BY ALL
), tops AS (
  SELECT n, head, p, max(CASE WHEN 2 * c > t THEN w END) AS w FROM (SELECT *, sum(c) OVER (PARTITION BY n, head, p) AS t FROM words) GROUP BY ALL
), patterns AS (
  SELECT n, head FROM tops GROUP BY ALL HAVING n >= 4 AND 4 * count(w) >= 3 * n AND count(*) FILTER (p > 3 AND regexp_matches(w, '\p{L}')) > 0
), ruled AS (
  SELECT m, (SELECT string_agg(coalesce(w, '<*>'), ' ' ORDER BY p) FROM tops WHERE tops.n = members.n AND tops.head = members.head) AS t
  FROM members JOIN patterns USING (n, head)
  WHERE NOT EXISTS (SELECT 1 FROM tops WHERE tops.n = members.n AND tops.head = members.head AND tops.w IS NOT NULL AND tops.w <> string_split(members.m, ' ')[tops.p])
), named AS (SELECT placed.*, coalesce(t, placed.m) AS t FROM placed LEFT JOIN ruled ON placed.m = ruled.m),
often AS (SELECT t FROM named WHERE m <> '' GROUP BY t HAVING count(DISTINCT th) >= 5),
marked AS (SELECT named.*, string_split(m, ' ') AS w, often.t IS NOT NULL AS shared FROM named LEFT JOIN often USING (t) WHERE m <> ''),
own AS (
  SELECT th, arg_max({'w': w, 'n': n}, (length(m), -i)) FILTER (NOT shared) AS r FROM marked
  GROUP BY th HAVING 3 * count(*) FILTER (NOT shared) >= count(*)
), about AS (
  SELECT th, array_to_string(r.w[1:CASE WHEN r.n < 4 THEN r.n ELSE least(3, (r.n + 1) // 2) END], ' ') AS h,
    [CASE WHEN r.n > 1 THEN array_to_string(r.w[r.n - least(3, r.n // 2) + 1:r.n], ' ') END, CASE WHEN r.n >= 6 THEN array_to_string(r.w[4:6], ' ') END,
     CASE WHEN r.n >= 6 THEN array_to_string(r.w[r.n - 5:r.n - 3], ' ') END] AS ends
  FROM own
), held AS (SELECT DISTINCT t, th, h, ends FROM marked JOIN about USING (th) WHERE shared),
heads AS (SELECT t, h, count(*) AS c FROM held GROUP BY ALL),
edited AS (SELECT t, sum(least(c, 5)) AS e FROM heads WHERE c > 1 GROUP BY t),
tails AS (SELECT DISTINCT t, h, x FROM (SELECT t, h, unnest(ends) AS x FROM held) WHERE x IS NOT NULL),
known AS (SELECT DISTINCT t, x FROM tails JOIN heads USING (t, h) WHERE c > 1),
stale AS (SELECT DISTINCT t, h FROM tails JOIN known USING (t, x)),
alone AS (SELECT t, count(*) AS a FROM heads ANTI JOIN stale USING (t, h) WHERE c = 1 GROUP BY t HAVING count(*) >= 5),
gone AS (SELECT t FROM alone LEFT JOIN edited USING (t) WHERE e IS NULL OR a >= e)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (m = '' OR gone.t IS NULL), '') AS text,
  count(*)::BIGINT AS n_lines, (count(*) FILTER (m <> '' AND gone.t IS NOT NULL))::BIGINT AS n_dropped
FROM named LEFT JOIN gone ON named.t = gone.t GROUP BY doc_id
"""
