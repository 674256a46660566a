"""Quality rules: basic repetition rules and distribution divergence, in DataFrame functions only.

A document's histogram of character classes and its histogram of common words
are compared with references of several languages by Jensen-Shannon distance;
the nearest language counts, so a wrong or missing label does no harm. References
are sums over all documents of that language. Short texts have no stable
histogram; minimum-length guards leave them to the basic rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.llm.shared import staged

# Frequent words of each language, and the languages with a reference.
COMMON_WORDS = {
    "en": "the of and to in is that it for was with on are by this be",
    "fr": "de la le et les des en un du une que est pour dans qui par",
    "de": "der die und in den von zu das mit sich des auf für ist nicht ein",
    "es": "de la que el en y los se del las un por con una su para",
}
LANGUAGES = tuple(COMMON_WORDS)
WORDS = tuple(dict.fromkeys(w for words in COMMON_WORDS.values() for w in words.split()))

#: Character classes as regular expressions; what is in none of them is the last class.
CLASSES = {
    "lower": "[a-z]",
    "upper": "[A-Z]",
    "accented": r"[\p{L}&&[^a-zA-Z]]",
    "digit": "[0-9]",
    "space": r"[ \t-\r]",
    "mark": r"[.,;:!?'\"()-]",
}
SPACE, ACCENTED = list(CLASSES).index("space"), list(CLASSES).index("accented")
WORD = r"[^\x20\x09-\x0D]+"

#: Guards and thresholds: words a text needs before a distance is judged, and the largest distance kept.
CLASS_WORDS, CLASS_DISTANCE = 50, 0.25
COMMON_WORDS_NEEDED, WORD_DISTANCE = 100, 0.75
MIN_WORDS = 50


def _with(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once.

    Spark merges neighbouring projections and repeats what they share; the counts here would be repeated for each of hundreds
    of uses. A generator of one row per row stands between them.
    """
    new = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_q_new")
    return df.select("*", new).select(*[F.col(f"`{c}`") for c in df.columns], "_q_new.*")


def _histograms(docs: DataFrame) -> DataFrame:
    """Add the counts per character class (``_q_class``) and per common word (``_q_words``), the text, its words and what is left of it.

    Classes are taken out one after another, the commonest first, so each expression reads only what the earlier ones left.
    """
    df = _with(docs, _q_text=F.coalesce(F.col("text").cast("string"), F.lit("")))
    left, names = "_q_text", []
    for k, pattern in enumerate(CLASSES.values()):
        df = _with(df, **{f"_q_left{k}": F.regexp_replace(left, pattern + "+", "")})
        names.append(f"_q_left{k}")
        left = names[-1]
    steps = ["_q_text", *names]
    counts = [F.length(x) - F.length(y) for x, y in zip(steps, names)]
    common = F.filter(F.regexp_extract_all(F.lower("_q_text"), F.lit(r"\p{L}+"), F.lit(0)), lambda x: x.isin(list(WORDS)))
    df = _with(df, _q_class=F.array(*counts, F.length(left)), _q_common=common, _q_rest=F.col(left),
               _q_w=F.regexp_extract_all("_q_text", F.lit(WORD), F.lit(0)))
    # every word stands between spaces of its own; one function over the list, as a loop written out would be too large to be compiled
    df = _with(df, _q_known=F.concat(F.lit(" "), F.array_join("_q_common", "  "), F.lit(" ")))
    cut = F.transform(F.array(*[F.lit(f" {w} ") for w in WORDS]), lambda w: F.length(F.replace(F.col("_q_known"), w, F.lit(""))))
    words = F.zip_with(cut, F.array(*[F.lit(len(w) + 2) for w in WORDS]), lambda n, size: ((F.length("_q_known") - n) / size).cast("int"))
    return _with(df, _q_words=words, n_words=F.size("_q_w").cast("long")).drop("_q_common", "_q_known", *names)


def references(docs: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """language -> (share of each character class, share of each common word), over all its documents."""
    return _references(_histograms(docs.select("text", F.col("lang").cast("string").alias("lang"))))


def _references(counted: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    sizes = {"_q_class": len(CLASSES) + 1, "_q_words": len(WORDS)}
    sums = [F.sum(F.when(F.col("lang") == lang, F.col(c)[k])).alias(f"{lang}{c}{k}")
            for lang in LANGUAGES for c, n in sizes.items() for k in range(n)]
    row = counted.agg(*sums).first()
    out = {}
    for lang in LANGUAGES:
        shares = []
        for c, n in sizes.items():
            counts = [row[f"{lang}{c}{k}"] or 0 for k in range(n)]
            shares.append([x / sum(counts) for x in counts] if sum(counts) else [])
        if all(shares):
            out[lang] = (shares[0], shares[1])
    return out


def _distance(counts: str, reference: list[float]) -> Column:
    """Square root of the Jensen-Shannon divergence in bits, 0 to 1."""
    shares = F.zip_with(F.transform(counts, lambda x: x / F.col(f"{counts}_total")), F.array(*map(F.lit, reference)), _divergence)
    return F.sqrt(F.greatest(F.aggregate(shares, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def _divergence(p: Column, q: Column) -> Column:
    """One term of twice the Jensen-Shannon divergence; a share of zero adds nothing."""
    m = (p + q) / 2
    return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0)) + F.when(q > 0, q * F.log2(q / m)).otherwise(F.lit(0.0))


def _nearest(counts: str, references_: list[list[float]]) -> Column:
    if not references_:
        return F.lit(0.0)
    found = [_distance(counts, r) for r in references_]
    # a histogram without any count is as far as can be
    return F.when(F.col(f"{counts}_total") > 0, F.least(*found) if len(found) > 1 else found[0]).otherwise(F.lit(1.0))


def _distances(df: DataFrame, refs: dict) -> DataFrame:
    names = ("_q_class", "_q_words")
    df = _with(df, **{f"{c}_total": F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x) for c in names})
    near = [F.round(_nearest(c, [r[k] for r in refs.values()]), 4) for k, c in enumerate(names)]
    return _with(df, class_distance=near[0], word_distance=near[1])


def _repetition(df: DataFrame) -> DataFrame:
    """Add the basic counts, from ``_q_text`` and its words ``_q_w``."""
    lines = F.filter(F.split("_q_text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # sort_array compares in one loop, array_sort calls a function for each comparison
    windows = ("sort_array(transform(slice(_q_w, 1, greatest(size(_q_w) - 2, 0)), "
               "(x, i) -> struct(xxhash64(x, get(_q_w, i + 1), get(_q_w, i + 2)) AS h, i AS i)))")
    df = _with(
        df, _q_lines=lines, _q_s=F.expr(windows),
        word_chars=(F.length("_q_text") - F.col("_q_class")[SPACE]).cast("long"),
        n_symbols=F.length(F.regexp_replace("_q_rest", r"[^#*$%&|<>]+", "")).cast("long"))
    # windows that equal a neighbour in hash order, by place; each covers three words or up to the next one
    twice = ("sort_array(filter(transform(_q_s, (x, k) -> CASE WHEN x.h = get(_q_s, k - 1).h OR x.h = get(_q_s, k + 1).h "
             "THEN x.i END), v -> v IS NOT NULL))")
    df = _with(df, _q_r=F.expr(twice), n_dup_lines=(F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"))
    covered = "aggregate(transform(_q_r, (v, k) -> least(3, coalesce(get(_q_r, k + 1) - v, 3))), 0L, (a, v) -> a + v)"
    return _with(df.drop("_q_s", "_q_lines", "_q_w", "_q_text", "_q_rest"), n_repeat_words=F.expr(covered)).drop("_q_r")


def _judged() -> Column:
    """Is there a reference of the document's language and script? Others pass on the basic rules.

    References are of Latin script, so a text most of whose letters are not plain Latin has none; nor has one labelled with another language.
    """
    letters = sum((F.col("_q_class")[k] for k, c in enumerate(CLASSES) if c in ("lower", "upper", "accented")), F.lit(0))
    return F.coalesce(F.col("lang").isin(*LANGUAGES), F.lit(True)) & (2 * F.col("_q_class")[ACCENTED] <= letters)


def _verdict(df: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    far = ((F.col("n_words") >= CLASS_WORDS) & (F.col("class_distance") > CLASS_DISTANCE)) | (
        (F.col("n_words") >= COMMON_WORDS_NEEDED) & (F.col("word_distance") > WORD_DISTANCE))
    return _with(_with(df, base_failed=failed), kept=~(F.col("base_failed") | (_judged() & far)))


def assess(docs: DataFrame) -> DataFrame:
    """A row of counts, distances and the verdict per document.

    Defined cases: null or empty text has no words and fails the basic rules; a null or other lang
    gives nothing to the references; a document of another language or script than the references have passes on the basic rules; without any reference the distances are 0; repeated rows and null
    ids are each judged; further columns are ignored. The counts are kept as a stage, so the
    text is read once.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counted = _repetition(_histograms(rows)).select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "_q_class", "_q_words")
    counted = staged(counted, "quality")
    out = _verdict(_distances(counted, _references(counted)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", "class_distance", "word_distance")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents whose verdict is kept, with their own columns. Cases as in ``assess``.

    The counts are kept as a stage beside the rows, so the texts are read once by the expressions.
    """
    text, lang = F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_q_row"), text, lang)
    counted = _repetition(_histograms(named)).select("_q_row", "lang", "n_words", "n_repeat_words", "_q_class", "_q_words")
    counted = staged(counted, "quality-rows")
    return _verdict(_distances(counted, _references(counted))).where("kept").select("_q_row.*")
