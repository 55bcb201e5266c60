"""Statistics of texts that tell running prose from lists, tables and junk.

Every document gets statistics of its text; every language the mean and covariance of them over its prose, estimated robustly
from all documents; and every document its Mahalanobis distance from the prose of its language, split into what each statistic
contributes. The distance alone tells what is prose.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.session import Stash

# Common words of each language, in no particular order.
COMMON = {
    "en": "the a an of to in is was were are be been has had have and or but not no that which who it its this these they them we you he she i my your our their so as at by for from with on if when while after before because although since until during each every all both there than then can could should would will near into nobody during according only some any very also one",
    "de": "der die das den dem des ein eine einen einem einer und oder aber nicht kein keine dass ist sind war waren wird wurde wurden hat haben hatte von vom zu zum zur in im an am auf für mit bei nach aus als auch es er sie wir ihr ich sich so wenn weil bevor ob noch nur schon über unter sein ihre diese dieser dieses alle um man muss kann",
    "fr": "le la les l un une des du de d et ou mais ne pas que qui est sont était étaient a ont avait avons été être il elle on nous vous ils elles je ce cette ces se sa son ses leur dans en au aux par pour sur avec sans si quand comme plus tout tous doit peut fois après avant",
    "es": "el la los las un una unos unas de del y o pero no que es son está están era fue ha han hemos había ser se su sus lo le les nos yo ella ellos este esta estos en al a por para con sin sobre si cuando como más muy todo todos tiene puede antes después veces",
    "it": "il lo la i gli le un uno una di del della dei delle e o ma non che è sono era ha hanno essere si suo sua nel nella in a al alla da dal per con su se quando come più tutto questo questa prima dopo",
    "pt": "o a os as um uma de do da dos das e ou mas não que é são era foi tem têm ser se seu sua no na nos nas em ao por para com sem sobre quando como mais todo este esta antes depois",
    "nl": "de het een en of maar niet geen dat die is zijn was waren wordt werd heeft hebben had van te in op aan met bij naar uit als ook er hij zij we wij je ik zich zo om voor door over nog dan deze dit alle moet kan",
}
LANGUAGES = tuple(COMMON)
_WORDS = {lang: frozenset(words.split()) for lang, words in COMMON.items()}
_ANY = {w: tuple(i for i, lang in enumerate(LANGUAGES) if w in _WORDS[lang]) for w in set().union(*_WORDS.values())}

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_MARK = re.compile(r"^\s*(?:>+\s*)*(?:[-*•‣◦+]\s+|(?:\d{1,3}|[a-zA-Z])[.)]\s+|#+\s+|\[[ xX]?\]\s+)*")
_QUOTE = re.compile(r"^\s*(?:>+\s*)+")
_STOP = re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+")
_ENTRY = re.compile(r"[,;|\t/]")
_END = tuple(".!?…:;\"'”’)")

#: A running sentence has so many words; so large a share of them are common words of one language, two different ones at least;
#: of n words DIFFERENT[0] * n ** DIFFERENT[1] are different ones; and between commas and the like stand so many words on average.
LEAST_WORDS, LEAST_COMMON, DIFFERENT, LEAST_ENTRY = 5, 0.22, (1.2, 0.6), 4.5
#: Lines are entries of their own, and not one wrapped text, if so many of the lines that follow an unfinished one begin with a
#: capital letter; the one break added to the count keeps a single noun at the begin of a line from deciding.
CAPITAL_BREAKS = 0.7

STATISTICS = ("log_words", "mean_word_length", "symbol_share", "digit_share", "stopped_lines", "common_words", "log_words_per_sentence", "odd_words", "repeated_lines", "sentence_share")


def _are_entries(lines: list[str]) -> bool:
    breaks = capital = 0
    for before, line in zip(lines, lines[1:]):
        if before and line and not before.endswith(_END):
            breaks += 1
            capital += line[0].isupper() and not line.isupper()
    return capital > CAPITAL_BREAKS * (breaks + 1)


def units(text: str) -> list[str]:
    """Stretches that could be sentences: of each paragraph, with wrapped lines joined and list marks taken off, what ends with a
    full stop. A line that begins with a mark begins a new stretch, and lines that read as entries are not joined."""
    out: list[str] = []
    held: list[str] = []

    def flush():
        if held:
            for x in held if _are_entries(held) else (" ".join(held),):
                out.extend(_STOP.split(x))
            held.clear()

    for line in text.split("\n"):
        bare = _QUOTE.sub("", line) if ">" in line else line
        if not bare.strip():
            flush()
            continue
        mark = _MARK.match(bare).end()
        if mark and bare[:mark].strip():
            flush()
        held.append(bare[mark:].strip())
    flush()
    return out


class Facts(dict):
    """(lower case, languages in which it is common, whether it is odd, its digits, its letters and digits) of a word, remembered for up
    to ``most`` short words."""

    def __init__(self, most: int = 300_000):
        self.most = most

    def __missing__(self, w: str) -> tuple[str, tuple[int, ...], bool, int, int]:
        low = w.lower()
        plain = low.isalpha() or low.isdecimal() or "'" in low or "’" in low
        mixed_case = w[1:] != low[1:] and w.isalpha() and not w.isupper()
        out = (low, _ANY.get(low, ()), not plain or mixed_case, sum(map(str.isdecimal, w)), sum(map(str.isalnum, w)))
        if len(w) <= 40:
            if len(self) >= self.most:
                self.clear()
            self[w] = out
        return out


def is_running(unit: str, words: list[tuple[str, tuple[int, ...], bool, int, int]]) -> bool:
    """By the language that has most of the unit's words in common."""
    n = len(words)
    if n < LEAST_WORDS:
        return False
    known = [w for w in words if w[1]]
    if len(known) < LEAST_COMMON * n:
        return False
    votes = [0] * len(LANGUAGES)
    for w in known:
        for i in w[1]:
            votes[i] += 1
    most = max(votes)
    if most < LEAST_COMMON * n:
        return False
    k = votes.index(most)
    common = {w[0] for w in known if k in w[1]}
    different = len({w[0] for w in words})
    return len(common) > 1 and max(map(len, common)) > 1 and different >= DIFFERENT[0] * n ** DIFFERENT[1] and n >= LEAST_ENTRY * len(_ENTRY.findall(unit))


def statistics(text: str, facts: Facts | None = None) -> tuple[str, list[float], int]:
    """The language, by common words, the statistics in their order, and the number of words. A text without words gets 0s."""
    facts = Facts() if facts is None else facts
    words = _WORD.findall(text)
    n = len(words)
    solid = sum(map(len, text.split()))
    votes = [0] * len(LANGUAGES)
    odd = digits = alnum = 0
    for w in words:
        _, languages, strange, decimals, solid_part = facts[w]
        odd += strange
        digits += decimals
        alnum += solid_part
        for i in languages:
            votes[i] += 1
    letters = sum(map(len, words))
    best = max(range(len(votes)), key=votes.__getitem__)
    lang = LANGUAGES[best] if votes[best] else ""
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    stopped = sum(x.endswith(_END) for x in lines)
    running = total = sentence_words = sentences = 0
    for u in units(text):
        ws = [facts[w] for w in _WORD.findall(u)]
        total += len(u)
        sentences += bool(ws)
        sentence_words += len(ws)
        if is_running(u, ws):
            running += len(u)
    x = [
        math.log1p(n),
        letters / n if n else 0.0,
        (solid - alnum) / solid if solid else 0.0,
        digits / solid if solid else 0.0,
        stopped / len(lines) if lines else 0.0,
        votes[best] / n if n else 0.0,
        math.log1p(sentence_words / sentences) if sentences else 0.0,
        odd / n if n else 0.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        running / total if total else 0.0,
    ]
    return lang, x, n


K = len(STATISTICS)
PAIRS = [(i, j) for i in range(K) for j in range(i, K)]
#: The squared distance beyond which a document is no prose. Far above the chi-squared quantile of as many degrees of freedom (20.5
#: for 0.975), as the statistics of prose have longer tails than normal ones.
CUTOFF = 64.0
#: Median of the chi-squared distribution with K degrees of freedom.
MIDDLE = K * (1 - 2 / (9 * K)) ** 3
#: Added to the standard deviation of each statistic, so that one that hardly varies in prose doesn't decide alone.
FLOOR = np.array([0.3, 0.3, 0.02, 0.02, 0.15, 0.04, 0.25, 0.04, 0.05, 0.06])
#: What is expected of prose before any document is seen, and the number of documents that this counts as. The estimate of a
#: language is drawn to that of all in the same way, so that few documents move it little and many make it their own.
PRIOR = (np.array([5.0, 5.0, 0.03, 0.01, 0.8, 0.4, 2.8, 0.05, 0.0, 1.0]), np.diag(9 * FLOOR**2))
PRIOR_DOCUMENTS = 50
#: Steps in which the nearer half of all documents is concentrated on, and steps of re-estimation for each language after them.
HALVES, STEPS = 2, 3
#: Distances are counted in bins, so many for a doubling; an edge lies at CUTOFF.
BINS = 8
ALL = "all"

Moments = tuple[int, np.ndarray]
Model = dict[str, tuple[np.ndarray, np.ndarray]]


def _inverse(cov: np.ndarray) -> np.ndarray:
    return np.linalg.inv(cov + np.diag(FLOOR**2))


def distances(x: np.ndarray, langs: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances and each statistic's contribution, which add up to them. ``model`` has means and inverse covariances."""
    out = np.zeros_like(x)
    langs_array = np.array([lang if lang in model else ALL for lang in langs])
    for lang in set(langs_array.tolist()):
        at = langs_array == lang
        mean, inverse = model[lang]
        d = x[at] - mean
        out[at] = d * (d @ inverse)
    return out.sum(axis=1), out


def _moments(stats: DataFrame, model: Model) -> dict[tuple[str, int], Moments]:
    """Of the documents of each language and bin of distance: how many there are, and the sums of their statistics and of the
    products of these. A row for each language and bin comes to the driver, at most some hundred for each language in COMMON."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack(b.column("x").to_numpy(zero_copy_only=False))
            langs = [v or ALL for v in b.column("lang").to_pylist()]
            d = distances(x, langs, model)[0]
            bins = np.ceil(BINS * np.log2(np.maximum(d, 1e-3) / CUTOFF)).astype(np.int64)
            rows: list[tuple[str, int, int, list[float]]] = []
            langs_array = np.array(langs)
            for lang in sorted(set(langs)):
                for k in np.unique(bins[langs_array == lang]).tolist():
                    y = x[(langs_array == lang) & (bins == k)]
                    rows.append((lang, k, len(y), [*y.sum(axis=0), *((y.T @ y)[i, j] for i, j in PAIRS)]))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=["lang", "bin", "n", "sums"])

    parts = stats.select("lang", "x").mapInArrow(weigh, "lang string, bin long, n long, sums array<double>")
    width = K + len(PAIRS)
    sums = parts.groupBy("lang", "bin").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width)]).alias("sums"))
    return {(r["lang"], r["bin"]): (r["n"], np.array(r["sums"])) for r in sums.collect()}


def _pooled(parts: list[Moments], mean: np.ndarray, cov: np.ndarray, weight: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of all the parts, drawn to the given ones as if these came from ``weight`` documents."""
    n = sum(p[0] for p in parts)
    if not n:
        return mean, cov
    sums = sum(p[1] for p in parts)
    own = sums[:K] / n
    spread = np.zeros((K, K))
    for c, (i, j) in enumerate(PAIRS):
        spread[i, j] = spread[j, i] = sums[K + c] / n - own[i] * own[j]
    share = n / (n + weight)
    return share * own + (1 - share) * mean, share * spread + (1 - share) * cov


def _middle(found: dict[tuple[str, int], Moments]) -> int:
    """The bin of the median distance."""
    half, seen = sum(n for n, _ in found.values()) / 2, 0
    for k in sorted({k for _, k in found}):
        seen += sum(n for (_, b), (n, _) in found.items() if b == k)
        if seen >= half:
            return k
    return 0


def fit(stats: DataFrame) -> Model:
    """Mean and inverse covariance of each language's prose, and of that of all, under the key ALL.

    The start is the median and median deviation of each statistic over all documents. Steps of concentration follow, each of which
    takes the mean and covariance of the nearer half of them; the covariance is then scaled to the median distance that is due. From
    there on the documents within CUTOFF count, each for its language, whose estimate is drawn to that of all. More than half of the
    documents have to be prose for that; of a table of few documents, PRIOR decides. All sums are made in Spark.
    """
    at = [F.get("x", F.lit(i)) for i in range(K)]
    row = stats.agg(*[F.percentile_approx(a, 0.5, 10_000) for a in at]).first()
    if row[0] is None:
        return {ALL: (PRIOR[0], _inverse(PRIOR[1]))}
    middle = np.array(row, float)
    off = stats.agg(*[F.percentile_approx(F.abs(a - m), 0.5, 10_000) for a, m in zip(at, middle.tolist())]).first()
    mean, cov = middle, np.diag((1.4826 * np.array(off, float)) ** 2)
    for _ in range(HALVES):
        found = _moments(stats, {ALL: (mean, _inverse(cov))})
        edge = _middle(found)
        mean, cov = _pooled([m for (_, k), m in found.items() if k <= edge], *PRIOR, 0)
    found = _moments(stats, {ALL: (mean, _inverse(cov))})
    edge = math.floor(BINS * math.log2(max(2.0 ** (_middle(found) / BINS) * CUTOFF / MIDDLE, 1.0)))
    for step in range(STEPS):
        near = {key: m for key, m in found.items() if key[1] <= edge}
        whole = _pooled(list(near.values()), *PRIOR, PRIOR_DOCUMENTS)
        model = {lang: _pooled([m for (v, _), m in near.items() if v == lang], *whole, PRIOR_DOCUMENTS) for lang in {v for v, _ in found} - {ALL}} | {ALL: whole}
        model = {lang: (m, _inverse(c)) for lang, (m, c) in model.items()}
        if step < STEPS - 1:
            found, edge = _moments(stats, model), 0
    return model


def quality(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document with a text: id, lang, n_words, the statistics, distance, a contribution of each statistic to its
    square (c_...), top_statistic, is_outlier and is_prose.

    The distance is that from the prose of the document's language, which is told by its common words; where there are none, from
    that of all. A document whose squared distance is above CUTOFF is an outlier and no prose. A text without any visible
    character counts as prose of nothing: is_prose holds. Null ids and texts are no case; rows that repeat an id each have their
    row; an empty table gives an empty result.
    """
    docs = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        facts = Facts()
        for b in batches:
            found = [(*statistics(t, facts), not t.strip()) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[2] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.float64())), pa.array([f[3] for f in found], pa.bool_())],
                names=["id", "lang", "n", "x", "blank"],
            )

    stats = Stash(docs.sparkSession).keep(docs.mapInArrow(measure, "id long, lang string, n long, x array<double>, blank boolean"))
    model = fit(stats)

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            d, c = distances(np.stack(b.column("x").to_numpy(zero_copy_only=False)), b.column("lang").to_pylist(), model)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("id", "lang", "n", "x", "blank")), pa.array(np.maximum(d, 0.0)), pa.array(list(c), pa.list_(pa.float64()))], names=["id", "lang", "n", "x", "blank", "d", "c"])

    held = stats.mapInArrow(hold, "id long, lang string, n long, x array<double>, blank boolean, d double, c array<double>")
    outlier = F.col("d") > CUTOFF
    names = F.array(*map(F.lit, STATISTICS))
    return held.select(
        F.col("id").alias(id), F.nullif("lang", F.lit("")).alias("lang"), F.col("n").alias("n_words"), *[F.get("x", F.lit(i)).alias(s) for i, s in enumerate(STATISTICS)], F.sqrt("d").alias("distance"),
        *[F.get("c", F.lit(i)).alias(f"c_{s}") for i, s in enumerate(STATISTICS)], F.get(names, (F.array_position("c", F.array_max("c")) - 1).cast("int")).alias("top_statistic"), outlier.alias("is_outlier"), (~outlier | F.col("blank")).alias("is_prose"),
    )
