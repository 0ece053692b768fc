"""Problem 9: text cut off by field limits.

Method. For every text the length is recomputed as it would have been when stored: code points, UTF-8 bytes, UTF-16
units, with entities escaped, as JSON, with CRLF line ends, the escaped forms in bytes too, and without a mark that was
appended. Lengths are counted by source and encoding; a length that many texts have, far more than the lengths around
it, is a hidden limit of that source. Then the endings are inspected: what was appended is taken off, and a text is cut
if it breaks off without the end of a sentence, unless its last line is of a kind that never has one (a running title,
"to be continued", a credit). Which kinds those are is learnt from the last lines of all texts. A spoken line that ends in
an ellipsis is complete if its last words end such lines in other texts as well. Where the ending leaves it open, the
limit decides: a closing line that is the beginning of a longer known one, a spoken ellipsis, or a quotation that closes
without the end of a sentence is a cut at a limit of its source, and none off every limit.

Texts are read whole: blanks are taken off the end first, however many; then the last line, however long, is inspected.

Defined results: null, empty and letterless texts are no cases; equal texts under several ids are judged alike; a null source is a
source of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.session import staged

#: A limit: at least so many texts of one length, so many times the mean of the lengths around it, plus so many, and so large
#: a share of them without the end of a sentence (texts of one length that all end well are of one kind, not cut).
LIMIT_LEAST, LIMIT_TIMES, LIMIT_MORE, AROUND, LIMIT_OPEN = 4, 8, 3, 15, 0.3
#: A kind of closing line: least number of texts, and least share of all texts, that end with it unfinished; share of its lines that do.
CLOSING_LEAST, CLOSING_SHARE, CLOSING_OPEN = 3, 2e-4, 0.8
#: Least number of characters of the end that are inspected (all of the last line if it is longer), and of the two last words.
END, MARKED = 80, 80
#: A closing line is shorter than this; a longer last line is ordinary text.
CLOSING_SIZE = 600

# Blanks and invisible characters, marks put where a text was cut, ends of sentences. ----------------------
BLANK = r"[\s\u0085\u00a0\u1680\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff\u00ad*~=#_]"
BLANKS = "".join(c for c in map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x2010), *range(0x2028, 0x2030), *range(0x205F, 0x2065), 0x3000, 0xFEFF, 0xAD])) + "*~=#_"
QUOTED = r"[^.!?…。！？\s][\"”»’'」』)\]]+$"
MORE = "read more|continue reading|see more|continued|more|continua lendo|continue lendo|leia mais|ler mais|continua|leer más|sigue leyendo|seguir leyendo|ver más|lire la suite|lire plus|voir plus|suite|truncated|cut"
MARK = rf"(?:\s*(?:[(\[](?:{MORE})(?:…|\.\.\.)?[)\]]?|[(\[](?:…|\.\.\.)[)\]]|<[A-Za-z/!][^<>\n]*|&#?[A-Za-z0-9]{{0,8}}|�+|\.\.\.|…))$"
CLOSED = r"[.!?…。！？][\"”»’'」』)\]\s]*$|[\]”»」』]$|[.!?…][^\p{L}\p{N}—–“«‘„¿¡(\[-]*$"
SPOKEN = r"^[—–“«\"„‘-]"
# ------------------------------------------------------------------------------------------------------------------------


def _count(text: Column, what: str) -> Column:
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(what), F.lit("")))) / len(what)


def stored_lengths(text: Column) -> dict[str, Column]:
    """The length of a text under each way of storing it."""
    points, octets = F.length(text), F.octet_length(text)
    entities = 4 * _count(text, "&") + 3 * (_count(text, "<") + _count(text, ">")) + 5 * (_count(text, '"') + _count(text, "'"))
    escapes = _count(text, '"') + _count(text, "\\") + _count(text, "\n") + _count(text, "\r") + _count(text, "\t")
    returns = _count(text, "\n") - _count(text, "\r\n")
    ways = {
        "code points": points, "UTF-8": octets, "UTF-16": F.octet_length(F.encode(text, "UTF-16BE")) / 2, "entities": points + entities, "entities, UTF-8": octets + entities,
        "JSON": points + escapes, "JSON, UTF-8": octets + escapes, "CRLF": points + returns, "CRLF, UTF-8": octets + returns,
    }
    return {k: v.cast("bigint") for k, v in ways.items()}


def endings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """What the inspection needs of each text: lengths, the appended mark, the end without it, its last line."""
    text = F.col(text_col)
    stripped = F.rtrim(text, F.lit(BLANKS))
    tail = F.expr(f"right(_stripped, greatest({END}, length(substring_index(_stripped, '\n', -1))))")
    ways = stored_lengths(text)
    rows = df.where(text.rlike(r"[\p{L}\p{N}]")).withColumn("_stripped", stripped).select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.xxhash64(text).alias("same"), F.length(text).alias("n"), F.octet_length(text).alias("bytes"),
        tail.alias("tail"), F.array(*(F.struct(F.lit(k).alias("way"), v.alias("size")) for k, v in ways.items())).alias("sizes"),
    )
    rows = rows.withColumn("mark", F.regexp_extract("tail", MARK, 0))
    base = F.rtrim(F.expr("left(tail, length(tail) - length(mark))"), F.lit(BLANKS))
    rows = rows.withColumn("base", base).withColumn("mark", F.trim("mark"))
    bare = F.when(F.col("mark") != "", F.array(
        F.struct(F.lit("code points").alias("way"), (F.col("n") - F.length("mark")).cast("bigint").alias("size")),
        F.struct(F.lit("UTF-8").alias("way"), (F.col("bytes") - F.octet_length("mark")).cast("bigint").alias("size")),
    )).otherwise(F.expr("CAST(array() AS array<struct<way: string, size: bigint>>)"))
    line = F.trim(F.substring_index("base", "\n", -1))
    masked = F.regexp_replace(line, r"\d+", "#")
    last = F.element_at(F.split("base", r"(?<=[.!?…”»\]])\s+|\n"), -1)
    return rows.select(
        "id", "source", "same", F.concat("sizes", bare).alias("sizes"), "mark", F.col("base").rlike(CLOSED).alias("closed"), F.col("base").rlike(QUOTED).alias("quoted"),
        F.when(F.length(line) < F.least(F.col("n"), F.lit(CLOSING_SIZE)) - 1, masked).alias("line"),
        F.when(F.col("mark").isin("…", "...") & last.rlike(SPOKEN), F.regexp_extract(F.substring("base", -MARKED, MARKED), r"(\S+\s+\S+)$", 1)).alias("words"),
    ).withColumn("opening", F.regexp_extract("line", r"^\S+(?:\s+\S+)?", 0))


def limits_of(ends: DataFrame) -> DataFrame:
    """Hidden limits: ``source, way, size, texts``, and how many of the texts end without the end of a sentence (``open``)."""
    broken = F.col("words").isNull() & (~F.col("closed") | (F.col("mark") != ""))  # what the ending itself leaves open tells nothing
    sizes = ends.select("source", F.explode("sizes").alias("x"), broken.alias("_open")).groupBy("source", "x.way", "x.size").agg(F.count("*").alias("texts"), F.count_if("_open").alias("open"))
    around = F.sum("texts").over(Window.partitionBy("source", "way").orderBy("size").rangeBetween(-AROUND, AROUND))
    mean = (around - F.col("texts")) / (2 * AROUND)
    return sizes.withColumn("_mean", mean).where((F.col("texts") >= LIMIT_LEAST) & (F.col("texts") > LIMIT_TIMES * F.col("_mean") + LIMIT_MORE) & (F.col("open") >= LIMIT_OPEN * F.col("texts"))).drop("_mean")


def closing_lines(ends: DataFrame, texts: int) -> DataFrame:
    """``opening``: first words of last lines that stand without the end of a sentence and are meant so."""
    count = lambda key: ends.where("opening != ''").groupBy(key).agg(F.count_distinct("same").alias("n"), F.count_distinct(F.when(~F.col("closed"), F.col("same"))).alias("open"))
    lines = count("opening").where((F.col("open") >= max(CLOSING_LEAST, CLOSING_SHARE * texts)) & (F.col("open") >= CLOSING_OPEN * F.col("n"))).select("opening")
    # A line of one word may be the beginning of any line that starts with it, so all of those have their say.
    first = F.regexp_extract("opening", r"^\S+", 0)
    words = count(first.alias("first")).where(F.col("open") < CLOSING_OPEN * F.col("n")).select(F.col("first").alias("opening"))
    return lines.join(words, "opening", "left_anti").withColumn("closing", F.lit(True))


def truncated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """Every text with the verdict (``id, source, cut, at_limit, reason``), and the limits."""
    ends = staged(endings(df, id_col, text_col, source_col))
    limits = staged(limits_of(ends))
    hit = ends.select("id", "source", F.explode("sizes").alias("x")).select("id", "source", "x.way", "x.size")
    hit = hit.join(limits.drop("texts", "open"), (hit["source"].eqNullSafe(limits["source"])) & (hit["way"] == limits["way"]) & (hit["size"] == limits["size"]), "left_semi").groupBy("id").agg(F.min("way").alias("at_limit"))

    known = closing_lines(ends, ends.count())
    lines = ends.join(known, "opening", "left_semi").where("NOT closed").groupBy("opening", "line").agg(F.count_distinct("same").alias("n"))
    after = F.lead("line").over(Window.partitionBy("opening").orderBy("line"))
    broken = lines.withColumn("_after", after).where("n < 2 AND _after IS NOT NULL AND startswith(_after, line)").select("opening", "line", F.lit(True).alias("beginning"))

    asked = ends.where("words != ''").select("words").distinct()
    pieces = F.split(F.col(text_col), r"…|!|\.\.\.")
    stops = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.regexp_extract(F.substring(p, -MARKED, MARKED), r"(\S+\s+\S+)$", 1))
    spoken = df.where(F.col(text_col).contains("…") | F.col(text_col).contains("!") | F.col(text_col).contains("..."))
    spoken = spoken.select(F.xxhash64(F.col(text_col)).alias("same"), F.explode(F.array_distinct(stops)).alias("words"))
    heard = spoken.join(asked, "words", "left_semi").groupBy("words").agg(F.count_distinct("same").alias("n")).where("n > 1").select("words", F.lit(True).alias("heard"))

    all_of = ends.join(known, "opening", "left").join(broken, ["opening", "line"], "left").join(heard, "words", "left").join(hit, "id", "left")
    ellipsis, limited = F.col("mark").isin("…", "..."), F.col("at_limit").isNotNull()
    reason = (
        F.when(ellipsis & ~F.coalesce("heard", F.lit(False)), "ellipsis inside a sentence")
        .when(ellipsis & limited, "spoken ellipsis at a limit")
        .when(ellipsis, None)
        .when((F.col("mark") != "") & (~F.col("closed") | F.col("mark").rlike("^[<&�]")), "mark after a broken end")
        .when(F.col("mark") != "", None)
        .when(F.col("closed"), F.when(F.col("quoted") & limited, "quotation without end at a limit"))
        .when(F.coalesce("closing", F.lit(False)), F.when(F.coalesce("beginning", F.lit(False)) & limited, "closing line cut at a limit"))
        .otherwise("no end of a sentence")
    )
    out = all_of.withColumn("reason", reason).select(F.col("id").alias(id_col), F.col("source").alias(source_col), F.col("reason").isNotNull().alias("cut"), "at_limit", "reason")
    return out, limits


def shares(judged: DataFrame, source_col: str = "source") -> DataFrame:
    """How often each source truncates: texts, cut, share."""
    return judged.groupBy(source_col).agg(F.count("*").alias("texts"), F.count_if("cut").alias("cut"), (F.count_if("cut") / F.count("*")).alias("share"))
