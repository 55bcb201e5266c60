import glob
import os

import numpy as np
import pytest

from textloom.llm import prose

SENTENCES = "The tutor has read the report before the meeting, and the group found that it was late. It is not clear whether the second draft of the example was better than the first one, but nobody had asked for it. When the work was done, they returned all of the files to the students. "
LIST = "- red apple\n- green pear\n- blue car\n- long river\n- small house\n- old tree\n"
TABLE = "id,name,value\n" + "\n".join(f"{i},item{i},{i * 0.37:.2f}" for i in range(20))
JUNK = "x9Fq/Zk3+TtUvW8aQ==pLmN0oIuYtR4eWq\n" * 6


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "z", 1.0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, distance double")


def test_kinds(spark):
    texts = [SENTENCES * (1 + k % 3) for k in range(60)] + [LIST, TABLE, JUNK, "no " * 40, SENTENCES + LIST, LIST * 8 + "That was all that was said. ", "", "   \n ", None, SENTENCES.lower().replace(".", "").replace(",", "")]
    got = {r["doc_id"]: r for r in prose.quality(frame(spark, texts)).collect()}
    assert all(got[k]["is_prose"] for k in range(60))
    assert [got[60 + k]["is_prose"] for k in (0, 1, 2, 3, 4, 5, 6, 7, 9)] == [False, False, False, False, True, False, True, True, True]
    assert 68 not in got
    r = got[60]
    assert r["is_outlier"] and abs(sum(r[f"c_{s}"] for s in prose.STATISTICS) - r["distance"] ** 2) < 1e-6 * r["distance"] ** 2
    assert r["top_statistic"] in prose.STATISTICS


def test_empty_table(spark):
    assert prose.quality(frame(spark, [])).count() == 0


def test_long_text(spark):
    assert prose.quality(frame(spark, [SENTENCES * 3000])).collect()[0]["is_prose"]


def test_statistics_by_hand():
    lang, x, n = prose.statistics("It is the end of it.\nA b-c 12")
    assert lang == "en" and n == 10
    assert x[4] == 0.5 and abs(x[3] - 2 / 21) < 1e-9


def test_layout_does_not_matter():
    flat = prose.statistics(SENTENCES)[1][-1]
    words, lines = SENTENCES.split(), []
    while words:
        lines.append(" ".join(words[:9]))
        words = words[9:]
    assert flat == 1.0 and prose.statistics("\n".join("> " + x for x in lines))[1][-1] == 1.0 and prose.statistics("1. " + SENTENCES.upper())[1][-1] == 1.0


@pytest.mark.parametrize("width", [18, 22, 26, 40, 70])
def test_narrow_wrapping(width):
    import textwrap

    assert prose.statistics("\n".join(textwrap.wrap(SENTENCES, width)))[1][-1] == 1.0


def test_entries_are_not_joined():
    entries = "Skeleton and archive\nRename the short upload\nExample and archive\nToken and solution\nReview the long draft\nFinal appeal"
    assert prose.statistics(entries)[1][-1] == 0.0


def test_distance_alone_decides(spark):
    rows = prose.quality(frame(spark, [SENTENCES * (1 + k % 3) for k in range(40)] + [LIST, TABLE, JUNK] * 4)).collect()
    assert all(r["is_prose"] == (r["distance"] ** 2 <= prose.CUTOFF) for r in rows) and {r["is_prose"] for r in rows} == {True, False}


def test_every_statistic_counts():
    """The same document, with one statistic far off, is an outlier by that one alone, the share of sentences being that of prose."""
    model = {prose.ALL: (prose.PRIOR[0], prose._inverse(prose.PRIOR[1]))}
    for i in range(prose.K - 1):
        x = prose.PRIOR[0].copy()
        x[i] += 30 * prose.FLOOR[i]
        d, c = prose.distances(np.array([x]), [""], model)
        assert d[0] > prose.CUTOFF and c[0].argmax() == i


def test_few_documents_are_drawn_to_all():
    """A language's estimate moves from that of all to its own without a step."""
    y = np.ones((1000, prose.K)) * 7
    means = []
    for n in (1, 49, 50, 51, 1000):
        part = (n, np.r_[y[:n].sum(0), [(y[:n].T @ y[:n])[i, j] for i, j in prose.PAIRS]])
        means.append(prose._pooled([part], *prose.PRIOR, prose.PRIOR_DOCUMENTS)[0][1])
    steps = np.diff(means)
    assert (steps > 0).all() and steps[1] < 0.02 and steps[2] < 0.02


LABELLED = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.exists(LABELLED), reason="no test tables")
def test_labels(spark):
    """Against the majority of the raters, who err in about one of fifty."""
    from pyspark.sql import functions as F

    from textloom.session import table

    votes = table(spark, LABELLED, "doc_labels").where("label IS NOT NULL").groupBy("doc_id").agg(F.avg((F.lower("label") == "prose").cast("double")).alias("v")).where("v <> 0.5")
    both = prose.quality(table(spark, LABELLED, "documents")).join(votes, "doc_id").select("is_prose", "v").collect()
    assert len(both) > 200 and sum(r["is_prose"] == (r["v"] > 0.5) for r in both) >= 0.95 * len(both)


def test_vocabulary_files():
    assert not glob.glob(os.path.join(os.path.dirname(prose.__file__), "*.tiktoken"))
