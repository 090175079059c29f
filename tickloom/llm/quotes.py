"""Quotation linking with DataFrame functions alone.

The lines of a message have a quote level, the number of leading ``>``. Runs of lines of one level, parted
by blank lines, are passages; normalised (one case, one blank between words, line ends forgotten) they are
hashed whole and by sentence. The earliest message of a conversation that says a passage itself is its
original. The passages of the lowest level with an original name the message replied to: the one most
words come from, the latest one of equals. Replies hang below what they answer, and a conversation in
reply order is its messages by ``path``, whose parts are the positions from the first message down.

Messages are told apart by all their columns, so repeated rows are one message and stay repeated in the
result. Order inside a conversation is by turn (null last). A null conversation is one of its own. Null
texts have no lines and stay null; a text of quotes alone becomes empty. Empty tables give no rows. Only
one row per passage meets the quotes, and no message text is shuffled but the result's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.session import checkpoint

LEAST_WORDS = 3  # of a sentence that links by itself
_PREFIX = r"^(?:[ \t]*>)+"
# lines that announce a quotation
_ANNOUNCE = r"(?i)^\s*(?:on|am|le|el)\b.{0,200}\b(?:wrote|schrieb|a écrit|escribió)\s*:\s*$"


def _lines(text: Column) -> Column:
    """(level, body) of each line."""
    prefix = lambda line: F.regexp_extract(line, _PREFIX, 0)
    return F.transform(
        F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n", -1),
        lambda line: F.struct(F.length(F.regexp_replace(prefix(line), "[^>]", "")).alias("level"), F.regexp_replace(line, _PREFIX, "").alias("body")),
    )


def _plain(body: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(body), r"\s+", " "))


def _passages(lines: Column) -> Column:
    """Runs of lines of one level without a blank one between them: (level, text)."""
    none = F.array().cast("array<struct<level:int,text:string>>")
    start = F.struct(none.alias("done"), F.lit(-1).alias("level"), F.array().cast("array<string>").alias("lines"))
    closed = lambda acc: F.when(
        F.size(acc["lines"]) > 0, F.array_append(acc["done"], F.struct(acc["level"].alias("level"), F.array_join(acc["lines"], " ").alias("text")))
    ).otherwise(acc["done"])

    def step(acc: Column, line: Column) -> Column:
        body = _plain(line["body"])
        ends = (line["level"] != acc["level"]) | (body == "")
        kept = F.when(body == "", F.array().cast("array<string>")).when(ends, F.array(body)).otherwise(F.array_append(acc["lines"], body))
        return F.struct(F.when(ends, closed(acc)).otherwise(acc["done"]).alias("done"), line["level"].alias("level"), kept.alias("lines"))

    return F.aggregate(lines, start, step, closed)


def _own(lines: Column) -> Column:
    """The text without quotes and what announces them."""
    kept = F.filter(lines, lambda line: (line["level"] == 0) & ~line["body"].rlike(_ANNOUNCE))
    text = F.array_join(F.transform(kept, lambda line: line["body"]), "\n")
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def messages(table: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """Each row with its message key, conversation key and order."""
    return table.select(
        F.struct(*table.columns).alias("_row"),
        F.xxhash64(*[F.col(c) for c in table.columns]).alias("_m"),
        F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("")).alias("_conv"),
        F.coalesce(F.col(turn).cast("long"), F.lit((1 << 63) - 1)).alias("_turn"),
        F.col(text).cast("string").alias("_text"),
    )


def _units(passages: DataFrame) -> DataFrame:
    """(_conv, _m, _turn, level, hash, words) of passages and their sentences."""
    words = lambda t: F.size(F.split(t, " "))
    whole = F.array(F.struct(F.col("p.text").alias("text"), F.lit(True).alias("whole")))
    sentences = F.filter(F.transform(F.split(F.col("p.text"), r"(?<=[.!?]) "), lambda s: F.struct(s.alias("text"), F.lit(False).alias("whole"))), lambda s: words(s["text"]) >= LEAST_WORDS)
    each = passages.select("_conv", "_m", "_turn", F.col("p.level").alias("level"), F.explode(F.concat(whole, sentences)).alias("u"))
    return each.select("_conv", "_m", "_turn", "level", F.sha2("u.text", 256).alias("hash"), words(F.col("u.text")).alias("words"))


def parents(rows: DataFrame) -> DataFrame:
    """(_m, _parent, _parent_turn): the message each message replies to by its quotes."""
    passages = rows.select("_conv", "_m", "_turn", F.explode(_passages(_lines(F.col("_text")))).alias("p"))
    units = _units(passages)  # repeated rows give equal units, which the sums below don't count twice
    first = checkpoint(units.where("level = 0").groupBy("_conv", "hash").agg(F.min(F.struct("_turn", "_m")).alias("o")))
    quoted = units.where("level > 0").groupBy("_conv", "_m", "_turn", "hash").agg(F.min("level").alias("level"), F.max("words").alias("words"))
    before = (F.col("o._turn") < F.col("_turn")) | ((F.col("o._turn") == F.col("_turn")) & (F.col("o._m") < F.col("_m")))
    found = quoted.join(first, ["_conv", "hash"]).where(before)
    by_origin = found.groupBy("_conv", "_m", "o").agg(F.min("level").alias("level"), F.sum("words").alias("words"))
    best = by_origin.groupBy("_conv", "_m").agg(F.max(F.struct(-F.col("level"), "words", "o._turn", "o._m")).alias("b"))
    return best.select("_conv", "_m", F.col("b._m").alias("_parent"), F.col("b._turn").alias("_parent_turn"))


def _paths(nodes: DataFrame) -> DataFrame:
    """(_conv, _m, path, depth) by pointer doubling: every round doubles the ancestors a path holds."""
    now = checkpoint(nodes)
    while now.where("_parent IS NOT NULL").limit(1).count():
        up = now.select("_conv", F.col("_m").alias("_parent"), F.col("_parent").alias("_next"), F.col("path").alias("above"))
        joined = now.join(up, ["_conv", "_parent"], "left")
        now = checkpoint(joined.select("_conv", "_m", F.col("_next").alias("_parent"), F.concat(F.coalesce("above", F.array().cast("array<string>")), "path").alias("path")))
    return now.select("_conv", "_m", F.array_join("path", ".").alias("path"), (F.size("path") - 1).alias("depth"))


def conversations(table: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """The rows with the text free of quotes, parent_turn, depth, path and n_quoted lines."""
    rows = messages(table, conv, turn, text)
    links = checkpoint(parents(rows))
    own = F.lpad(F.col("_turn").cast("string"), 19, "0")
    nodes = rows.select("_conv", "_m", "_turn").distinct().join(links, ["_conv", "_m"], "left")
    places = checkpoint(_paths(nodes.select("_conv", "_m", "_parent", F.array(own).alias("path"))))
    lines = _lines(F.col("_text"))
    placed = rows.join(places, ["_conv", "_m"]).join(links, ["_conv", "_m"], "left")
    return placed.select(
        *[F.col(f"_row.`{c}`").alias(c) for c in table.columns if c not in (text, "parent_turn", "depth", "path", "n_quoted")],
        F.when(F.col("_text").isNotNull(), _own(lines)).alias(text),
        F.col("_parent_turn").alias("parent_turn"),
        "depth",
        "path",
        F.size(F.filter(lines, lambda line: line["level"] > 0)).alias("n_quoted"),
    )
