"""Problem 4: broken prompt and response pairs.

Method. Responses are stripped of labels, courtesies, fences and marks to their core. The different cores are sorted by
text without an ellipsis at the end (range partitions, neighbours across partition edges included) and compared with their
neighbours: one whose whole text is a prefix of those that follow, one of which goes on within a word, is a shortened
version. Lengths shared by unfinished responses far more than the lengths around them are limits of a model. Both decide
where the ending leaves it open. Then the rules: empty, refusal (outside of what
characters say), copy of the instruction or the paragraph (hashes of the letters, so paragraphs are not moved), a broken
end, and another language than expected by the n-gram model, fitted on a bounded sample of responses.

Defined results: a null response is empty; a response of letters the model cannot judge keeps its language; a missing
paragraph cannot be copied; a null instruction expects no language; repeated rows count once. A row gets one defect, the
first of empty, refusal, copy, truncated, wrong_language.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm import langid
from folioscope.session import staged

#: Bound of the sample for the language model: responses of each language (up to 1,000 the engine ranks within partitions
#: first), and their characters.
SAMPLE, SAMPLE_CHARS = 1_000, 20_000
#: Least number of characters of a response that may be a shortened one.
STEM = 8
LIMIT_LEAST, LIMIT_TIMES, LIMIT_MORE, AROUND = 5, 8, 3, 10

# Labels, courtesies, placeholders, refusals. ------------------------------------------------------------
LABELS = "answer|response|translation|translated text|result|output|text|continuation|resposta|tradução|texto|resultado|continuação|respuesta|traducción|continuación|réponse|traduction|résultat|texte|suite"
COURTESY = "sure|certainly|of course|absolutely|ok|okay|yes|claro|com certeza|certo|por supuesto|desde luego|bien sûr|certainement|d'accord|voici"
HERE = "here is|here's|here you go|below is|aqui está|aqui vai|segue|aquí está|aquí tiene|a continuación|voici|voilà"
PLACEHOLDERS = "n/?a|none|null|nil|nan|undefined|empty|todo|tbd|vazio|nenhum|nenhuma|vacío|ninguno|vide|aucun|aucune|sem resposta|sin respuesta|sans réponse|no answer|no response"
REFUSALS = [
    r"\b(?:can(?:no|')?t|cannot|can not|won't|will not|unable to|not able to|must decline|have to decline|have to pass|not comfortable|don't feel comfortable|decline to)\b[^.!?]*\b(?:help|assist|translate|write|answer|respond|continue|provide|comply|request|content|passage|text|that|this)\b",
    r"\bmust decline\b|\bhave to pass on\b|\bagainst my (?:guidelines|policy|policies|rules)\b|\bdon't feel comfortable\b|\bas an? (?:ai|writing assistant|assistant|language model|translation assistant)\b",
    r"\bnão (?:posso|consigo|vou poder|me é possível|me sinto)\b[^.!?]*\b(?:ajudar|traduzir|escrever|responder|continuar|atender|pedido|conteúdo|trecho|texto|isso)\b",
    r"\bprefiro não responder\b|\bpreciso recusar\b|\bcontra as minhas (?:diretrizes|regras)\b|\bcomo assistente\b|\bdevo recusar\b",
    r"\bno (?:puedo|me es posible|podré|voy a poder)\b[^.!?]*\b(?:ayudar|traducir|escribir|responder|continuar|atender|petición|solicitud|contenido|pasaje|texto|eso)\b",
    r"\bprefiero no responder\b|\bdebo rechazar\b|\bpor mis normas\b|\bcontra mis (?:normas|reglas)\b|\bcomo asistente\b",
    r"\bne (?:peux|pourrai|puis) pas\b[^.!?]*\b(?:aider|traduire|écrire|répondre|continuer|demande|contenu|passage|texte|cela)\b",
    r"\bm'est impossible\b|\bdois refuser\b|\bcontraire à mes règles\b|\bpréfère ne pas répondre\b|\ben tant qu'assistant",
]
#: What characters say is no refusal: text in quotes, and from a dash to the end of the line.
SPEECH = r"“[^”]*(?:”|$)|«[^»]*(?:»|$)|(?:^|(?<=[\n.!?…\]:»”] ?))\s*[—–]\s?[^\n]*"
CLOSED = r"[.!?…。！？][\"”»’'」』)\]*_`~\s]*$|[\]”»」』][*_`\s]*$"
# ------------------------------------------------------------------------------------------------------------------------


def core_of(text: Column) -> Column:
    """A response without invisible characters, labels, courtesies, fences, quotation marks and emphasis around it."""
    c = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\u200b-\u200f\u2060-\u2064\ufeff\u00ad]+", "")
    c = F.regexp_replace(c, r"[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]", " ")
    for _ in range(3):
        c = F.regexp_replace(c, r"^\s*```[\w-]*\s*|\s*```\s*$", "")
        c = F.regexp_replace(c, rf"(?iu)^\s*(?:{COURTESY})\s*[!.,:;]+\s*", "")
        c = F.regexp_replace(c, rf"(?iu)^\s*(?:{HERE})\b[^\n:]{{0,80}}:\s*", "")
        c = F.regexp_replace(c, rf"(?iu)^\s*(?:\*\*|__|#+\s*)?(?:{LABELS})\s*(?:\*\*|__)?\s*:\s*(?:\*\*|__)?\s*", "")
        c = F.regexp_replace(c, r"^\s*(?:>\s*)+|\n\s*>\s?", " ")
        c = F.regexp_replace(c, r"(?s)^\s*(\*\*|__|\*|_)(.+?)\1\s*$", "$2")
        c = F.regexp_replace(c, r'(?s)^\s*"([^"]*)"\s*$', "$1")
        c = F.trim(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return c


def letters_of(text: Column) -> Column:
    """Letters and digits without accents that are typed apart, ignoring case."""
    return F.lower(F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+", "")))


def is_empty(core: Column) -> Column:
    bare = F.trim(F.regexp_replace(F.regexp_replace(core, r"<[^<>]*>", " "), r"&nbsp;?", " "))
    bare = F.regexp_replace(bare, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return (bare == "") | bare.rlike(rf"(?iu)^(?:{PLACEHOLDERS}|{LABELS})$")


def is_refusal(core: Column) -> Column:
    told = F.lower(F.regexp_replace(F.regexp_replace(core, SPEECH, " "), "[’`]", "'"))
    return _any([told.rlike("(?u)" + p) for p in REFUSALS])


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def stem_of(core: Column) -> Column:
    """A response without the ellipsis at its end, which is what it is sorted by."""
    dots = core.rlike(r"(?:…|\.\.\.)$")
    return F.when(dots, F.rtrim(core, F.lit("…. \n\t"))).otherwise(core)


def shortened(cores: DataFrame) -> DataFrame:
    """``core`` of responses that are a proper beginning of another, which goes on within a word.

    ``cores`` has distinct texts. They are sorted by their stems in range partitions; the stems that the text at hand goes
    on from form a stack, so a neighbour that goes on otherwise hides none behind it. What the last text of a partition
    still goes on from is joined with the texts of the other partitions on the first letters, if the next one begins with it.
    """
    ranged = cores.select("core", stem_of(F.col("core")).alias("stem")).where(F.length("stem") >= STEM).repartitionByRange("stem", "core").sortWithinPartitions("stem", "core")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, first, stack = TaskContext.get().partitionId(), None, []
        for f in frames:
            found = []
            for core, stem in zip(f["core"], f["stem"]):
                first = stem if first is None else first
                while stack and not stem.startswith(stack[-1][1]):
                    stack.pop()
                for waiting in stack:
                    if waiting[0] is not None and goes_on(waiting[1], stem):
                        found.append((waiting[0], "found", part, waiting[1]))
                        waiting[0] = None
                stack.append([core, stem])
            if found:
                yield pd.DataFrame(found, columns=["core", "kind", "part", "stem"])
        rest = [(core, "open", part, stem) for core, stem in stack if core is not None]
        yield pd.DataFrame([*rest, (None, "first", part, first)], columns=["core", "kind", "part", "stem"])

    rows = staged(ranged.mapInPandas(run, "core string, kind string, part int, stem string"))
    # The next partition's first stem (null: it is empty, so the one behind it may go on).
    firsts = rows.where("kind = 'first'").select((F.col("part") - 1).alias("part"), F.col("stem").alias("_next"), F.lit(True).alias("_known"))
    over = rows.where("kind = 'open'").join(firsts, "part").where("_next IS NULL OR startswith(_next, stem)").select(F.col("core").alias("_core"), F.col("stem").alias("_stem"), F.left("stem", F.lit(STEM)).alias("_head"))
    heads = ranged.select("stem", F.left("stem", F.lit(STEM)).alias("_head"))
    behind = F.substring("stem", F.length("_stem") + 1, F.lit(1)).rlike(r"\p{L}") & F.col("_stem").rlike(r"\p{L}$")
    crossing = over.join(heads, "_head").where(F.startswith("stem", "_stem") & behind).select(F.col("_core").alias("core"))
    return rows.where("kind = 'found'").select("core").unionByName(crossing)


def goes_on(stem: str, other: str) -> bool:
    """Whether a response that begins with ``stem`` goes on within a word of it."""
    return len(stem) >= STEM and len(other) > len(stem) and other.startswith(stem) and stem[-1].isalpha() and other[len(stem)].isalpha()


def asked_language(instruction: Column) -> Column:
    """The language that an instruction names."""
    names = {n: c for c, ns in langid.CODES.items() for n in ns.split() if len(n) > 4}
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    words = F.regexp_extract_all(F.lower(instruction), F.lit(r"\p{L}{5,}"), 0)
    return F.try_element_at(F.filter(F.transform(words, lambda w: F.try_element_at(known, w)), lambda c: c.isNotNull()), F.lit(1))


def fit_model(rows: DataFrame, sample: int = SAMPLE) -> langid.Model:
    """A language model from at most ``sample`` different responses a target language, chosen by a hash of the text."""
    texts = rows.where(f"target_lang IS NOT NULL AND length(core) BETWEEN 20 AND {SAMPLE_CHARS}").select(F.lower(F.trim("target_lang")).alias("label"), "core").distinct()
    ranked = texts.withColumn("_n", F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("core"), "core"))).where(F.col("_n") <= sample)
    found = [(r["label"][:2], r["core"]) for r in ranked.collect()]
    often = {x for x, n in pd.Series([x for x, _ in found]).value_counts().items() if n >= langid.LEAST} if found else set()
    found = sorted(x for x in found if x[0] in often) or [("en", "")]
    return langid.Model.fit([t.replace("\n", " ") for _, t in found], [x for x, _ in found])


def spoken_languages(texts: DataFrame, model: langid.Model, column: str) -> DataFrame:
    """``column, lang, leads``: the language of distinct texts (null if only names could tell), and its lead over each language."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for f in frames:
            texts = [t.replace("\n", " ").replace("\r", " ") for t in f[column]]
            scores, letters, _ = m.score(texts)
            best = scores.argmax(1)
            yield pd.DataFrame({
                column: f[column], "lang": [m.languages[b] if n else None for b, n in zip(best, letters)],
                "leads": [{x: float(s[b] - s[j]) for j, x in enumerate(m.languages)} for s, b in zip(scores, best)],
            })

    return texts.select(column).mapInPandas(run, f"{column} string, lang string, leads map<string, double>")


def paragraph_letters(df: DataFrame, origin: str, id_col: str) -> DataFrame:
    """Hashes of the letters of all paragraphs: what a copy is held against."""
    hashes = F.transform("paragraphs", lambda p: F.xxhash64(letters_of(p)))
    return df.select(F.lit(origin).alias("origin"), F.col(id_col).alias("origin_id"), hashes.alias("hashes")).dropDuplicates(["origin_id"])


def judged(chunks: DataFrame, chapters: DataFrame, sections: DataFrame) -> DataFrame:
    """Every chunk with what the rules found: chunk_id, defect (null if none), and the evidence of shortening and limits."""
    own = chunks.select("chunk_id", "origin", "origin_id", "paragraph_index", "task", "instruction", "target_lang", "output_text", "model_name").dropDuplicates(["chunk_id"])
    core = core_of(F.col("output_text"))
    rows = own.withColumn("core", core).select(
        "chunk_id", "origin", "origin_id", "paragraph_index", "task", "instruction", "target_lang", "model_name", "core", F.length(stem_of(F.rtrim("output_text"))).alias("size"),
        is_empty(core).alias("empty"), is_refusal(core).alias("refusal"), core.rlike(CLOSED).alias("closed"), letters_of(core).alias("letters"), letters_of(F.col("instruction")).alias("asked"),
    )
    rows = staged(rows)

    hashes = paragraph_letters(chapters, "chapter", "chapter_id").unionByName(paragraph_letters(sections, "section", "section_id"))
    source = rows.select("chunk_id", "origin", "origin_id", "paragraph_index").join(hashes, ["origin", "origin_id"]).select("chunk_id", F.try_element_at("hashes", F.col("paragraph_index") + 1).alias("paragraph"))

    full = rows.where("NOT empty")
    short = shortened(full.select("core").distinct()).distinct().withColumn("short", F.lit(True))
    # A limit cuts before anything is appended, so the length is that without an ellipsis.
    sizes = full.where(~F.col("closed") | F.col("core").rlike(r"(?:…|\.\.\.)$")).groupBy("model_name", "size").agg(F.count("*").alias("n"))
    around = F.sum("n").over(Window.partitionBy("model_name").orderBy("size").rangeBetween(-AROUND, AROUND))
    spikes = sizes.withColumn("_mean", (around - F.col("n")) / (2 * AROUND)).where((F.col("n") >= LIMIT_LEAST) & (F.col("n") > LIMIT_TIMES * F.col("_mean") + LIMIT_MORE)).select("model_name", "size", F.lit(True).alias("limit"))

    model = fit_model(full)
    said = spoken_languages(full.select("core").distinct(), model, "core")
    named = asked_language(F.col("instruction"))
    instructions = rows.where("target_lang IS NULL AND instruction IS NOT NULL").select("instruction").distinct()
    meant = spoken_languages(instructions, model, "instruction").select("instruction", F.col("lang").alias("own_lang"))

    at = rows.join(source, "chunk_id", "left").join(short, "core", "left").join(said, "core", "left").join(meant, "instruction", "left")
    at = at.join(spikes, at["model_name"].eqNullSafe(spikes["model_name"]) & (at["size"] == spikes["size"]), "left").drop(spikes["model_name"]).drop(spikes["size"])
    expected = F.coalesce(F.lower(F.substring(F.trim("target_lang"), 1, 2)), F.when(F.col("task") == "translate", named), "own_lang")
    rest = F.when((F.col("asked") != "") & F.startswith("letters", "asked"), F.expr("substring(letters, length(asked) + 1)"))
    copied = (
        ((F.col("asked") != "") & (F.col("letters") == F.col("asked")))
        | ((F.col("letters") != "") & (F.xxhash64("letters") == F.col("paragraph")))
        | ((rest != "") & (F.xxhash64(rest) == F.col("paragraph")))
    )
    # A character's line may end in an ellipsis; the narrator's does not.
    last = F.element_at(F.split("core", r"(?<=[.!?…”»\]])\s+|\n"), -1)
    ellipsis = F.col("core").rlike(r"(?:…|\.\.\.)[*_`\s]*$") & ~last.rlike(r"^[—–“«\"„‘-]") & last.rlike(r"\p{L}.*\s.*\p{L}")
    name = (F.col("task") == "question") & F.col("core").rlike(r"^(?:\p{Lu}[\p{L}-]*\s?){1,4}$")
    # A shorter version of another response, and a length that many unfinished ones of a model share, decide what the ending
    # leaves open: an answer that is only a name, a spoken line with an ellipsis.
    dots = F.col("core").rlike(r"(?:…|\.\.\.)[*_`\s]*$")
    cut = F.coalesce("short", F.lit(False)) | (F.coalesce("limit", F.lit(False)) & (dots | ~F.col("closed")))
    truncated = F.when(name, cut).otherwise(~F.col("closed") | ellipsis | cut)
    foreign = F.coalesce(F.try_element_at("leads", expected) > langid.MARGIN, F.lit(False))
    defect = (
        F.when(F.col("empty"), "empty").when(F.col("refusal"), "refusal").when(F.coalesce(copied, F.lit(False)), "copy")
        .when(truncated, "truncated").when(foreign & (F.col("lang") != expected), "wrong_language")
    )
    return at.select("chunk_id", defect.alias("defect"), F.coalesce("short", F.lit(False)).alias("shortened"), F.coalesce("limit", F.lit(False)).alias("at_limit"), "lang", expected.alias("expected"))


def defects(chunks: DataFrame, chapters: DataFrame, sections: DataFrame) -> DataFrame:
    return judged(chunks, chapters, sections).where("defect IS NOT NULL").select("chunk_id", "defect")
