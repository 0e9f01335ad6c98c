import re
from collections import Counter
from fractions import Fraction

import corpus_pipeline
from specweave.llm import mixing, packing, toxicity
from specweave.runtime import materialize
from tests.llm.test_operators import WORD, plain_components

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        tables.append(materialize(stage(spark, tables[-1], SF), name))
        assert tables[-1].columns == docs.columns
    rows = [[tuple(r) for r in t.collect()] for t in tables]
    # Toxicity: a document stays, as it is, if and only if its score is below the cut.
    low = {r.doc_id for r in toxicity.score_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("score < 0.3").collect()}
    assert rows[1] and sorted(rows[1]) == sorted(r for r in rows[0] if r[0] in low)
    # Near-duplicates: by full sets of all pairs, the smallest id of each group.
    group = plain_components([(r[0], r[1]) for r in rows[1]], 5, Fraction(4, 5))
    assert sorted(rows[2]) == sorted(r for r in rows[1] if group[r[0]][1] == r[0]) and len(rows[2]) < len(rows[1])
    # Mixing: whole documents as often as half a pass or more takes them, near each source's target.
    took = {r.doc_id: r for r in mixing.mix(tables[2]).collect()}
    copies = Counter(r[0] for r in rows[3])
    assert set(rows[3]) <= set(rows[2])
    assert all(copies[i] == (int(r.taken / r["size"] + 0.5) if r["size"] else 0) for i, r in took.items())
    words = lambda text: len(re.findall(WORD, text or ""))
    assert all(took[r[0]]["size"] == words(r[1]) for r in rows[2])
    for source in {r[3] for r in rows[2]}:
        mine = {r[0] for r in rows[2] if r[3] == source}
        assert abs(sum(took[i].taken for i in mine) - took[next(iter(mine))].target) <= 0.03 * took[next(iter(mine))].target + 64
    # Packing: all words of all copies once, in bins within their rules.
    packed = corpus_pipeline.run(spark, SF).collect()
    placed = Counter()
    for x in packed:
        placed[x.doc_id] += x.n_words
    assert placed == Counter({i: n * took[i]["size"] for i, n in copies.items()})
    bins: dict = {}
    for x in packed:
        bins.setdefault(x.bin_id, []).append(x)
    bins.pop(None, None)
    for b in bins.values():
        assert sum(x.n_words for x in b) <= packing.CAPACITY and len({x.cluster for x in b}) == len(b)
        assert max(Counter(x.source for x in b).values()) <= packing.PER_SOURCE


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, clashing and extra columns; and no rows at all."""
    columns = "doc_id long, text string, lang string, source string, n_chars long, size int, component_id string"
    text = "one two three four five six seven " * 3
    rows = [(1, text, None, None, None, 1, None), (1, text, None, None, None, 1, None), (None, None, None, None, None, None, None), (2, "", "en", "a", 0, 2, "x"), (None, text, "en", "a", 5, 3, "y"), (3, "w " * 30_000, "en", "hot", 9, 4, "z")]
    spark.createDataFrame([(1, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for given in (rows, []):
        docs = spark.createDataFrame(given, columns)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = materialize(stage(spark, docs, str(tmp_path)), "odd")
            assert docs.columns == [c.split()[0] for c in columns.split(", ")]
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        assert bool(packed) == bool(given) and {x.doc_id for x in packed} <= {1, 2, 3, None}
