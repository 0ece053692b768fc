"""Problem 1: sentence alignment in bilingual documents.

Method. Chapters of the two editions of a book are paired by the words that both editions share (names, numbers). The
paired documents are the concepts: a word's concept vector has the paired documents in which it occurs, and the cosine
of a source word's and a target word's vectors says how alike their concepts are. A sentence is represented by the
similarities of its words to the concepts of the target words; a sparse join on those dimensions gives the cosines of all
sentences of a chapter pair. Spans are single sentences and merged windows of two, whose cosine follows from the dot
products of their parts. Mutual best spans are selected in rounds: a pair of spans is taken if no pair that shares a
sentence with it ranks higher; the next round goes on with the sentences left. Nearness in the chapter decides between
equals. A sentence left over then joins the window of a pair whose one side it explains further (``widened``). With a
first draft of the pairs, the concepts are refined from chapters to the paired sentences, and the join runs again.

The products of two words lie where they are made: vectors are dealt by ``pair`` once, and the aggregates and windows by
``pair`` and more keys need no other shuffle; only cosines of ``KEPT`` and more are moved.

Defined results: null, blank and letterless sentences and translator's notes pair with nothing; repeated rows count
once; a chapter without counterpart leaves its sentences alone; books whose language is not declared take the language
whose books share most of their words; a book with one edition gives nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.session import staged

#: Least cosine of a pair of spans, least cosine that is kept, weight of the distance.
LEAST, KEPT, APART = 0.42, 0.1, 0.1
#: What a window of neighbours must gain over its parts, and what a sentence left over must explain further.
GAIN, FURTHER = 0.05, 0.06
#: Rounds of the mutual best selection.
ROUNDS = 4
#: Least number of shared documents, least concept similarity, and dimensions of a word.
SHARED, ALIKE, DIMENSIONS = 3, 0.15, 8
#: Source chapters of a book that one group compares with all chapters of its translation.
DEALT = 64
#: Least cosine of two chapters, and of two sentences from which concepts are refined.
CHAPTERS, REFINE = 0.3, 0.5
#: The first concepts are those of words in at most this share of the chapters; the common words follow with the refined ones.
TELLING = 0.2

# Number words from two on, accents that are folded, openings of notes. -----------------------
NUMBERS = {
    "en": "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty",
    "pt": "dois tres quatro cinco seis sete oito nove dez onze doze treze catorze quinze dezesseis dezessete dezoito dezenove vinte",
    "es": "dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciseis diecisiete dieciocho diecinueve veinte",
    "fr": "deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize dix-sept dix-huit dix-neuf vingt",
}
ACCENTED = "áàâãäåāçéèêëēíìîïīñóòôõöōúùûüūýÿ"
PLAIN = "aaaaaaaceeeeeiiiiinoooooouuuuuyy"
NOTES = r"(?i)^[^\p{L}]*(?:N\.\s?(?:de la |do |du |d\.\s?)?[TE]\.|T\.?N\.|Nota:|Note:|Nota d[aeo]l? (?:tradu|trad|edi)|Note d[eu] (?:la )?(?:trad|l.édi)|Translat\w+.s note|Note from the transl)"
# -----------------------------------------------------------------------------------------------------------------------


def words_of(text: Column) -> Column:
    """Folded words of a text, number words as digits; the same for composed and decomposed characters."""
    plain = F.translate(F.regexp_replace(F.lower(text), r"\p{M}+", ""), ACCENTED, PLAIN)
    plain = F.regexp_replace(F.regexp_replace(plain, "œ", "oe"), r"[\u200b-\u200d\u2060\ufeff\u00ad]+", "")
    digits = {w: str(i) for ws in NUMBERS.values() for i, w in enumerate(ws.split(), 2)} | {"duas": "2"}
    known = F.create_map(*[F.lit(x) for pair in digits.items() for x in pair])
    return F.transform(F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*"), 0), lambda w: F.coalesce(F.try_element_at(known, w), w))


def sentences_of(nodes: DataFrame) -> DataFrame:
    """Sentences in order with their words: book_id, edition, section_id, node_id, idx (from 1), pos (0 to 1), words."""
    rows = nodes.select("book_id", "edition", "section_id", "node_id", "node_key", "text").where("text IS NOT NULL AND edition IN ('source', 'translation')")
    rows = rows.where(F.col("text").rlike(r"[\p{L}\p{N}]") & ~F.col("text").rlike(NOTES))
    section = Window.partitionBy("book_id", "edition", "section_id").orderBy("node_key", "node_id")
    whole = Window.partitionBy("book_id", "edition", "section_id")
    rows = rows.withColumn("_rank", F.dense_rank().over(section)).withColumn("_again", F.lag("node_id").over(section) == F.col("node_id"))
    rows = rows.withColumn("pos", F.col("_rank") / F.max("_rank").over(whole)).where("_again IS NULL OR NOT _again")
    return rows.select("book_id", "edition", "section_id", "node_id", F.col("_rank").alias("idx"), "pos", words_of(F.col("text")).alias("words"))


def languages_of(books: DataFrame, terms: DataFrame) -> DataFrame:
    """``book_id, languages`` (as ``en>pt``): the declared ones, or those whose books share most words."""
    said = books.groupBy("book_id").agg(F.max("source_lang").alias("source"), F.max("target_lang").alias("translation"))
    said = said.select("book_id", F.expr("stack(2, 'source', source, 'translation', translation) AS (edition, said)"))
    words = terms.select("book_id", "edition", "term").distinct().join(said, ["book_id", "edition"], "left")
    known = words.where("said IS NOT NULL").groupBy("edition", "said", "term").agg(F.count("*").alias("n"))
    size = known.groupBy("edition", "said").agg(F.max("n").alias("most"))
    known = known.join(size, ["edition", "said"]).select("edition", F.col("said").alias("guess"), "term", (F.col("n") / F.col("most")).alias("share"))
    votes = words.where("said IS NULL").join(known, ["edition", "term"]).groupBy("book_id", "edition", "guess").agg(F.sum("share").alias("votes"))
    guessed = votes.groupBy("book_id", "edition").agg(F.max(F.struct("votes", "guess")).alias("g")).select("book_id", "edition", F.col("g.guess").alias("guess"))
    both = words.select("book_id", "edition", "said").distinct().join(guessed, ["book_id", "edition"], "left").withColumn("lang", F.coalesce("said", "guess", F.lit("?")))
    pair = both.groupBy("book_id").agg(F.max(F.when(F.col("edition") == "source", F.col("lang"))).alias("s"), F.max(F.when(F.col("edition") == "translation", F.col("lang"))).alias("t"))
    return pair.where("s IS NOT NULL AND t IS NOT NULL").select("book_id", F.concat_ws(">", "s", "t").alias("languages"))


def chapter_pairs(terms: DataFrame, shared: DataFrame) -> DataFrame:
    """Mutual best chapters ``book_id, pair, target_section`` by the cosine of their shared words, in rounds; pair is the source section.

    ``terms``: book_id, edition, section_id, term, tf. ``shared``: book_id, term, ds, dt of words in both editions. All shared
    words count at any distance. The source chapters of a book are dealt into groups, each with the whole translation, and
    the products of two words are summed up where they are made.
    """
    sizes = terms.groupBy("book_id").agg(F.count_distinct("edition", "section_id").alias("_n"))
    weight = (1 + F.log("tf")) * F.log(1 + F.col("_n") / (F.col("ds") + F.col("dt")))
    weighed = terms.join(shared, ["book_id", "term"]).join(sizes, "book_id").withColumn("w", weight)
    norms = weighed.groupBy("section_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    deals = F.ceil(F.count_distinct(F.when(F.col("edition") == "source", F.col("section_id"))) / DEALT)
    dealt = weighed.select("book_id", "edition", "section_id", "term", "w").join(terms.groupBy("book_id").agg(deals.alias("_deals")).where("_deals > 0"), "book_id")
    groups = F.when(F.col("edition") == "source", F.array(F.pmod(F.xxhash64("section_id"), F.col("_deals")))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("_deals") - 1))
    dealt = dealt.withColumn("_deal", F.explode(groups)).drop("_deals").repartition("book_id", "_deal")
    side = lambda e: F.collect_list(F.when(F.col("edition") == e, F.struct("section_id", "w")))
    lists = dealt.groupBy("book_id", "_deal", "term").agg(side("source").alias("_s"), side("translation").alias("_t"))
    each = lists.select("book_id", "_deal", F.explode("_s").alias("_x"), "_t").select("book_id", "_deal", "_x", F.explode("_t").alias("_y"))
    dots = each.groupBy("book_id", "_deal", F.col("_x.section_id").alias("s"), F.col("_y.section_id").alias("t")).agg(F.sum(F.col("_x.w") * F.col("_y.w")).alias("dot")).drop("_deal")
    cos = dots.join(norms.toDF("s", "ns"), "s").join(norms.toDF("t", "nt"), "t").withColumn("cos", F.col("dot") / (F.col("ns") * F.col("nt"))).where(F.col("cos") >= CHAPTERS)
    mutual = mutual_best(cos.select(F.col("book_id").alias("pair"), F.array("s", "t").alias("places"), "cos", F.col("cos").alias("rank")))
    return mutual.select(F.col("pair").alias("book_id"), F.col("places")[0].alias("pair"), F.col("places")[1].alias("target_section"))


def concepts(documents: DataFrame) -> DataFrame:
    """Similar words ``languages, term, dim, z`` from paired documents ``languages, doc, s, t`` (arrays of distinct words).

    z is the cosine of the two words' document vectors above what chance gives; the squares of a word's z sum to one.
    """
    docs = documents.select("languages", "s", "t")
    total = docs.groupBy("languages").agg(F.count("*").alias("n"))
    count = lambda c: docs.select("languages", F.explode(c).alias(f"w_{c}")).groupBy("languages", f"w_{c}").agg(F.count("*").alias(f"d_{c}"))
    ds, dt = count("s"), count("t")
    both = docs.select("languages", "t", F.explode("s").alias("w_s")).select("languages", "w_s", F.explode("t").alias("w_t")).groupBy("languages", "w_s", "w_t").agg(F.count("*").alias("d")).where(F.col("d") >= SHARED)
    known = both.join(ds, ["languages", "w_s"]).join(dt, ["languages", "w_t"]).join(total, "languages")
    mean = F.sqrt(F.col("d_s") * F.col("d_t"))
    z = (F.col("d") / mean - mean / F.col("n")) / (1 - mean / F.col("n") + 1e-9)
    ranked = known.withColumn("z", z).where(F.col("z") > ALIKE).withColumn("_r", F.row_number().over(Window.partitionBy("languages", "w_s").orderBy(F.desc("z"), "w_t"))).where(F.col("_r") <= DIMENSIONS)
    norm = F.sqrt(F.sum(F.col("z") * F.col("z")).over(Window.partitionBy("languages", "w_s")))
    return ranked.select("languages", F.col("w_s").alias("term"), F.col("w_t").alias("dim"), (F.col("z") / norm).alias("z"))


def vectors(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """What each word adds to the concept vectors: pair, place (sentences of the source even, of the translation odd), pos, dim, v."""
    source, target = words.where("edition = 'source'"), words.where("edition = 'translation'")
    row = lambda d, side, dim, v: d.select("pair", (2 * F.col("idx") + side).alias("place"), "pos", F.xxhash64(dim).alias("dim"), v.alias("v"))
    # An anchor (name, number) stands for itself, whatever words it has been seen with.
    meant = row(source.where("NOT anchor").join(lexicon, ["languages", "term"], "left"), 0, F.coalesce("dim", "term"), F.col("w") * F.coalesce("z", F.lit(1.0)))
    return meant.unionByName(row(source.where("anchor"), 0, F.col("term"), F.col("w"))).unionByName(row(target, 1, F.col("term"), F.col("w")))


def sentence_cosines(vectors: DataFrame) -> DataFrame:
    """Pairs of sentences of a chapter pair, of two editions or of one, with a cosine: pair, a, b, dot, and norm squared and
    place in the chapter of both (a2, ap, b2, bp)."""
    v = vectors.repartition("pair").groupBy("pair", "place", "dim").agg(F.sum("v").alias("v"), F.max("pos").alias("pos"))
    v = v.withColumn("n2", F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("pair", "place")))
    lists = v.groupBy("pair", "dim").agg(F.collect_list(F.struct("place", "v", "n2", "pos")).alias("s")).where("size(s) > 1")
    each = lists.select("pair", F.explode("s").alias("a"), "s").select("pair", "a", F.explode("s").alias("b")).where("a.place < b.place")
    dots = each.groupBy("pair", F.col("a.place").alias("a"), F.col("b.place").alias("b")).agg(
        F.sum(F.col("a.v") * F.col("b.v")).alias("dot"), F.max("a.n2").alias("a2"), F.max("a.pos").alias("ap"), F.max("b.n2").alias("b2"), F.max("b.pos").alias("bp"),
    )
    return dots.where(F.col("dot") >= KEPT * F.sqrt(F.col("a2") * F.col("b2")))


def across(cosines: DataFrame) -> DataFrame:
    """Sentences t with sentences p of the other edition, from both sides: pair, t, p, dot, t2, p2, cos, rank."""
    c = cosines.where((F.col("a") + F.col("b")) % 2 == 1)
    c = c.withColumn("cos", F.col("dot") / F.sqrt(F.col("a2") * F.col("b2"))).withColumn("rank", F.col("cos") - APART * F.abs(F.col("ap") - F.col("bp")))
    turned = lambda t, p: c.select("pair", F.col(t).alias("t"), F.col(p).alias("p"), "dot", F.col(f"{t}2").alias("t2"), F.col(f"{p}2").alias("p2"), "cos", "rank")
    return turned("a", "b").unionByName(turned("b", "a"))


def _beside(rows: DataFrame, cosines: DataFrame) -> DataFrame:
    """Rows with ``both``: the dot product of the sentences ``m`` and ``p`` of one edition."""
    same = cosines.where((F.col("a") + F.col("b")) % 2 == 0).select("pair", F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("dot").alias("both"))
    keyed = rows.withColumn("_a", F.least("m", "p")).withColumn("_b", F.greatest("m", "p"))
    return keyed.join(same, ["pair", "_a", "_b"], "left").withColumn("both", F.coalesce("both", F.lit(0.0))).drop("_a", "_b")


def spans(cosines: DataFrame, least: float = LEAST, windows: bool = True) -> DataFrame:
    """Spans that may render one another: pair, places, cos, rank. One sentence on one side, one or a window of two on the other.

    A window holds the best partner of a sentence and a neighbour of it, and must be nearer to it than each of them by ``GAIN``.
    """
    rows = across(cosines)
    single = rows.where((F.col("t") < F.col("p")) & (F.col("cos") >= least)).select("pair", F.array("t", "p").alias("places"), "cos", "rank")
    if not windows:
        return single
    first = F.max(F.struct("rank", (-F.col("p")).alias("_p"), "p", "dot", "p2", "cos")).over(Window.partitionBy("pair", "t"))
    more = rows.withColumn("_m", first).where("abs(p - _m.p) = 2").select("*", F.col("_m.p").alias("m"), F.col("_m.dot").alias("m_dot"), F.col("_m.p2").alias("m2"), F.col("_m.cos").alias("m_cos"), F.col("_m.rank").alias("m_rank"))
    cos = (F.col("dot") + F.col("m_dot")) / F.sqrt(F.col("t2") * (F.col("p2") + F.col("m2") + 2 * F.col("both")))
    wide = _beside(more, cosines).withColumn("_cos", cos).where(F.col("_cos") >= F.greatest(F.lit(least), GAIN + F.greatest("cos", "m_cos")))
    away = (F.col("cos") - F.col("rank") + F.col("m_cos") - F.col("m_rank")) / 2
    return single.unionByName(wide.select("pair", F.array("t", "m", "p").alias("places"), F.col("_cos").alias("cos"), (F.col("_cos") - away).alias("rank")))


def mutual_best(spans: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Of spans ``pair, places, cos, rank`` those that rank highest for all their sentences, round after round."""
    key = F.struct("rank", F.transform("places", lambda x: -x).alias("order"))
    rows = spans.repartition("pair").withColumn("key", key).withColumn("place", F.explode("places"))
    place, span = Window.partitionBy("pair", "place"), Window.partitionBy("pair", "places")
    for _ in range(rounds):
        rows = rows.withColumn("_best", F.col("key") == F.max("key").over(place)).withColumn("taken", F.min("_best").over(span))
        rows = rows.withColumn("_used", F.max("taken").over(place)).withColumn("_out", F.max("_used").over(span)).where("taken OR NOT _out")
    return rows.where("taken").groupBy("pair", "places").agg(F.max("cos").alias("cos"))


def widened(chosen: DataFrame, cosines: DataFrame, least: float = LEAST) -> DataFrame:
    """Sentences left over that render what the partner of another sentence leaves unsaid: spans as in ``spans``.

    Of a sentence t with its partner m, the part that m does not explain is compared with the sentence p left over, less
    what m and p have in common: p joins m as a window at any distance, so a part that was moved is found as well.
    """
    pairs = chosen.where("size(places) = 2")
    partner = pairs.select("pair", F.col("places")[0].alias("t"), F.col("places")[1].alias("m")).unionByName(pairs.select("pair", F.col("places")[1].alias("t"), F.col("places")[0].alias("m")))
    used = chosen.select("pair", F.explode("places").alias("p"))
    rows = across(cosines)
    whole = rows.select("pair", "t", F.col("p").alias("m"), F.col("dot").alias("m_dot"), F.col("p2").alias("m2"))
    left = rows.join(used, ["pair", "p"], "left_anti").join(partner, ["pair", "t"]).join(whole, ["pair", "t", "m"])
    explained = F.col("m_dot") * F.col("m_dot") / F.col("m2")
    rest = F.col("t2") - explained
    own = F.col("p2") - F.col("both") * F.col("both") / F.col("m2")
    cos = (F.col("dot") - F.col("m_dot") * F.col("both") / F.col("m2")) / F.sqrt(F.greatest(rest, F.lit(1e-9)) * F.greatest(own, F.lit(1e-9)))
    gain = F.sqrt((explained + rest * F.col("_cos") * F.col("_cos")) / F.col("t2")) - F.sqrt(explained / F.col("t2"))
    out = _beside(left, cosines).withColumn("_cos", cos).where((F.col("_cos") >= least) & (gain >= FURTHER))
    return out.select("pair", F.array("t", "p").alias("places"), F.col("_cos").alias("cos"), (F.col("_cos") + F.col("rank") - F.col("cos")).alias("rank"))


def align(nodes: DataFrame, books: DataFrame, least: float = LEAST) -> DataFrame:
    """Sentences that render one another: ``source_node, target_node, cos``."""
    sentences = staged(sentences_of(nodes))
    terms = staged(
        sentences.select("book_id", "edition", "section_id", F.explode("words").alias("term"))
        .groupBy("book_id", "edition", "section_id", "term").agg(F.count("*").alias("tf"))
    )
    each = lambda e: F.count(F.when(F.col("edition") == e, 1))
    shared = staged(terms.groupBy("book_id", "term").agg(each("source").alias("ds"), each("translation").alias("dt")).where("ds > 0 AND dt > 0"))
    anchors = shared.where("least(ds, dt) * 2 >= greatest(ds, dt)").select("book_id", "term", F.lit(True).alias("anchor"))
    pairs = chapter_pairs(terms, shared).join(languages_of(books, terms), "book_id")
    pairs = staged(pairs.select("pair", "languages", F.expr("stack(2, 'source', pair, 'translation', target_section) AS (edition, section_id)")))

    plain_terms = terms.join(anchors, ["book_id", "term"], "left_anti").join(pairs, ["edition", "section_id"]).select("languages", "edition", "pair", "term")
    chapters_of = pairs.groupBy("languages", "edition").agg(F.count("*").alias("_n"))
    telling = plain_terms.groupBy("languages", "edition", "term").agg(F.count("*").alias("_df")).join(chapters_of, ["languages", "edition"])
    telling = telling.where((F.col("_df") >= SHARED) & (F.col("_df") <= TELLING * F.col("_n"))).select("languages", "edition", "term")
    known = plain_terms.join(telling, ["languages", "edition", "term"]).groupBy("languages", "edition", "pair").agg(F.collect_list("term").alias("words"))
    side = lambda e: F.max(F.when(F.col("edition") == e, F.col("words")))
    chapters = known.groupBy("languages", "pair").agg(side("source").alias("s"), side("translation").alias("t"))
    lexicon = staged(concepts(chapters))

    number = sentences.groupBy("edition").agg(F.count("*").alias("_all"))
    rarity = sentences.select("edition", F.explode(F.array_distinct("words")).alias("term")).groupBy("edition", "term").agg(F.count("*").alias("_df"))
    idf = rarity.join(number, "edition").select("edition", "term", F.log(1 + F.col("_all") / (1 + F.col("_df"))).alias("_idf"))
    in_pairs = staged(sentences.join(pairs, ["edition", "section_id"]).select("pair", "languages", "book_id", "edition", "node_id", "idx", "pos", "words"))
    # The words of a sentence are counted in the row itself.
    words = in_pairs.select("pair", "languages", "book_id", "edition", "idx", "pos", F.explode(F.array_distinct("words")).alias("term"), "words")
    words = words.select("pair", "languages", "book_id", "edition", "idx", "pos", "term", F.least(F.size("words") - F.size(F.array_remove("words", F.col("term"))), F.lit(2)).alias("_tf"))
    words = words.join(idf, ["edition", "term"]).join(anchors, ["book_id", "term"], "left")
    words = staged(words.select("pair", "languages", "edition", "idx", "pos", "term", (F.col("_idf") * F.sqrt("_tf")).alias("w"), F.coalesce("anchor", F.lit(False)).alias("anchor")))

    held = lexicon.select("languages", F.expr("stack(2, 'source', term, 'translation', dim) AS (edition, term)")).distinct()
    told = words.where("anchor").unionByName(words.where("NOT anchor").join(held, ["languages", "edition", "term"], "left_semi"))
    draft = staged(mutual_best(spans(sentence_cosines(vectors(told, lexicon)), REFINE, windows=False)))
    plain = words.where("NOT anchor").groupBy("edition", "languages", "pair", "idx").agg(F.collect_list("term").alias("words"))
    of = lambda e, at, c: plain.where(F.col("edition") == e).select("languages", "pair", F.col("idx").alias(at), F.col("words").alias(c))
    at = lambda parity: F.try_element_at(F.filter("places", lambda x: x % 2 == parity), F.lit(1))
    drafted = draft.select("pair", ((at(0)) / 2).cast("int").alias("i"), ((at(1) - 1) / 2).cast("int").alias("j"))
    paired = drafted.join(of("source", "i", "s"), ["pair", "i"]).join(of("translation", "j", "t").drop("languages"), ["pair", "j"])
    lexicon = staged(concepts(paired.select("languages", "s", "t")))
    cosines = staged(sentence_cosines(vectors(words, lexicon)))
    chosen = staged(mutual_best(spans(cosines, least)))
    found = chosen.unionByName(mutual_best(widened(chosen, cosines, least)))
    # A window of two is two pairs.
    each = found.select("pair", F.explode(F.filter("places", lambda x: x % 2 == 0)).alias("s"), F.filter("places", lambda x: x % 2 == 1).alias("_t"), "cos").select("pair", "s", F.explode("_t").alias("t"), "cos")
    node = lambda e, side, at, c: in_pairs.where(F.col("edition") == e).select("pair", (2 * F.col("idx") + side).alias(at), F.col("node_id").alias(c))
    out = each.join(node("source", 0, "s", "source_node"), ["pair", "s"]).join(node("translation", 1, "t", "target_node"), ["pair", "t"])
    return out.groupBy("source_node", "target_node").agg(F.max("cos").alias("cos"))
