"""Line dedup by a tree of log templates.

Variable fields first: a token with a digit becomes <*>. The tree has a fixed depth: a line goes to the leaf of its number
of tokens and its ``LEADING`` first tokens. The line of a leaf that most documents hold (two at least) is its template; lines of
the leaf belong to it if they agree with it in ``LIKE`` of their tokens or more, and in more than half of those beyond the
leading ones; their other tokens are variable fields. Any other line is a template by itself. A template that ``min_docs``
documents or more hold is recurring: its lines are dropped from every document but the first that holds it. Lines without a
word (a token with a letter and no digit) have nothing constant, and are never dropped: they are rows of figures.

All of it is DataFrame operations. Leaves are counted by their hash; the text of lines is compared only in leaves that
enough documents hold, and counts combine before the shuffle. min_docs is above the size of ordinary groups of copied
documents, which are left to near-duplicate search; shorter lines than ``min_tokens`` recur by chance and stay.

Defined results: a null text has no lines and stays null; an empty text has one empty line; blank lines are never dropped;
rows equal in doc_id and text count once and lose the same lines; rows with the first doc_id all keep the line; null doc_ids come
after all others; an empty table gives no rows; other columns stay in ``deduplicated``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.shared import materialise

LEADING = 8
LIKE = 0.7
MIN_DOCS, MIN_TOKENS = 10, 3
#: A word: a token with a letter and no digit.
WORD = r"(?<![^ ])[^ 0-9]*\p{L}[^ 0-9]*(?![^ ])"
#: White space within lines, besides blanks.
SPACES = "\t\r\f\x0b"
#: Comes after every doc_id.
NONE = (1 << 63) - 1


def token_count(line):
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def masked(line):
    """A plain line with <*> for tokens with digits."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*", "<*>")).otherwise(line)


def leaf(line):
    """Token count and leading tokens of a plain line, <*> for those with digits."""
    return F.concat_ws(" ", token_count(line).cast("string"), masked(F.substring_index(line, " ", LEADING)))


def alike(line, seed):
    """Whether a masked line belongs to the template of its leaf."""

    def agreeing(a, b):
        return F.size(F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: p["a"] == p["b"]))

    a, b = F.split(line, " "), F.split(seed, " ")
    rest = F.greatest(F.size(a) - LEADING, F.lit(0))
    constant = F.exists(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: (p["a"] == p["b"]) & p["a"].rlike(r"\p{L}"))
    further = agreeing(F.slice(a, F.lit(LEADING + 1), rest), F.slice(b, F.lit(LEADING + 1), rest))
    return (line == seed) | ((agreeing(a, b) >= LIKE * F.size(a)) & (2 * further > rest) & constant)


def order_of_doc():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE))


def leaves(docs: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """doc, copy (hash of the text), number, leaf (hash), line (plain) of the lines that are long enough."""
    # Once per text: per line, translate would run again in every expression that reads the line.
    lines = F.split(F.regexp_replace("text", f"[{SPACES}]", " "), "\n")
    lines = docs.select(order_of_doc().alias("doc"), F.xxhash64("text").alias("copy"), F.posexplode(lines).alias("number", "line"))
    lines = lines.withColumn("line", F.trim("line")).where(token_count(F.col("line")) >= min_tokens)
    return lines.select("doc", "copy", "number", digest(leaf(F.col("line"))).alias("leaf"), "line")


def digest(text):
    # Never null, so that joins by it need no filter for nulls, which would hash every line a second time.
    return F.coalesce(F.unhex(F.md5(text.cast("binary"))), F.lit(b""))


def counted(lines: DataFrame, *keys: str) -> DataFrame:
    """The keys with docs, the documents that hold them, and first, the first that does."""
    by_doc = lines.groupBy(*keys, "doc", "copy").agg(F.lit(1).alias("one"))
    return by_doc.groupBy(*keys).agg(F.count(F.lit(1)).alias("docs"), F.min("doc").alias("first"))


def placed(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc, copy, number, template (hash) of the lines with a word in leaves that enough documents hold."""
    crowded = materialise(counted(lines, "leaf").where(F.col("docs") >= min_docs).select("leaf"), "leaves")
    held = lines.join(crowded, "leaf")
    held = materialise(held.select("doc", "copy", "number", "leaf", masked(F.col("line")).alias("line")), "lines")
    # Here, not before the join: the pattern would run over every line of the table.
    kinds = counted(held.where(F.col("line").rlike(WORD)), "leaf", "line")
    seeds = kinds.where("docs > 1").groupBy("leaf").agg(F.max(F.struct("docs", "line")).alias("seed"))
    kinds = kinds.select("leaf", "line").join(seeds.select("leaf", F.col("seed.line").alias("seed")), "leaf", "left")
    template = F.when(F.col("seed").isNotNull() & alike(F.col("line"), F.col("seed")), F.col("seed")).otherwise(F.col("line"))
    kinds = kinds.select("leaf", "line", digest(template).alias("template"))
    return materialise(held.join(kinds, ["leaf", "line"]).select("doc", "copy", "number", "template"), "templates")


def recurring(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """template, first: the templates that enough documents hold, and the first that does."""
    return _recurring(placed(lines, min_docs), min_docs)


def _recurring(lines: DataFrame, min_docs: int) -> DataFrame:
    return counted(lines, "template").where(F.col("docs") >= min_docs).select("template", "first")


def dropped(docs: DataFrame, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """doc, copy, lines: numbers of the lines to drop."""
    lines = placed(leaves(docs, min_tokens), min_docs)
    gone = lines.join(_recurring(lines, min_docs), "template").where("doc > first")
    return gone.groupBy("doc", "copy").agg(F.collect_set("number").alias("lines"))


def deduplicated(docs: DataFrame, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """docs with text (and n_chars, where there is one) as it is left, and n_lines and n_dropped.

    Columns of docs that have these two names are replaced.
    """
    others = F.struct(F.lit(0).alias("_"), *[F.col(c) for c in docs.columns if c != "text"])
    keyed = docs.select(others.alias("row"), "text", order_of_doc().alias("doc"), F.xxhash64("text").alias("copy"))
    # Sorted at every size: lists small enough to be sent to all tasks would leave the texts in place on small inputs only.
    joined = keyed.join(dropped(docs, min_docs, min_tokens).hint("merge"), ["doc", "copy"], "left")
    pieces = F.split("text", "\n")
    kept = F.filter(pieces, lambda line, number: ~F.array_contains("lines", number))
    text = F.when(F.col("lines").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    joined = joined.withColumn("left", text)
    out = {c: F.col("row")[c] for c in docs.columns if c != "text"} | {"text": F.col("left")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.length("left").cast(docs.schema["n_chars"].dataType)
    out["n_lines"] = F.when(F.col("text").isNull(), 0).otherwise(F.size(pieces)).cast("long")
    out["n_dropped"] = F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long")
    names = [*docs.columns, *(c for c in ("n_lines", "n_dropped") if c not in docs.columns)]
    return joined.select(*[out[c].alias(c) for c in names])


def digests(docs: DataFrame, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row."""
    out = deduplicated(docs.select("doc_id", "text"), min_docs, min_tokens)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


_PLAIN = "trim(translate({0}, chr(9) || chr(13) || chr(12) || chr(11), '    '), ' ')"
_LEAD = f"array_to_string(string_split(plain, ' ')[1:{LEADING}], ' ')"
#: The same by plain SQL.
ORACLE = f"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, {NONE}) AS doc, text FROM documents),
lines AS (SELECT r, doc, number, line, text, {_PLAIN.format("line")} AS plain
   FROM (SELECT r, doc, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS number FROM rows)),
placed AS (SELECT *, len(string_split(plain, ' ')) AS n, regexp_replace({_LEAD}, '[^ ]*[0-9][^ ]*', '<*>', 'g') AS lead FROM lines),
totals AS (SELECT n, lead, min(doc) AS first FROM placed WHERE n >= {MIN_TOKENS} GROUP BY n, lead HAVING count(DISTINCT (doc, text)) >= {MIN_DOCS}),
gone AS (SELECT p.r, p.number FROM placed p JOIN totals t ON p.n = t.n AND p.lead = t.lead WHERE p.doc > t.first),
kept AS (SELECT l.r, string_agg(l.line, chr(10) ORDER BY l.number) AS text FROM lines l LEFT JOIN gone g ON l.r = g.r AND l.number = g.number WHERE g.r IS NULL GROUP BY l.r),
n AS (SELECT l.r, count(*) AS n_lines, count(g.r) AS n_dropped FROM lines l LEFT JOIN gone g ON l.r = g.r AND l.number = g.number GROUP BY l.r)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM rows LEFT JOIN n USING (r) LEFT JOIN kept USING (r)
"""
