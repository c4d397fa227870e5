"""The pipeline stage by stage against brute force, and its odd rows."""

import collections
import hashlib

import pyarrow as pa
from test_text_operators import SECRETS, brute_linked, brute_secrets, check_packing, contamination, grams, jaccard, long_text

import corpus_pipeline
from quarry.llm import cluster, decontamination, packing, queries, toxicity


def test_stages_against_brute_force(spark, sf, tmp_path):
    docs = queries.table(spark, sf, "documents")
    extra = [(9_000_000 + k, t, "en", "src0", len(t)) for k, t in enumerate([*SECRETS, long_text(300, 1), long_text(300, 1) + " more", ""])]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    (tmp_path / "in").mkdir()
    docs.coalesce(1).write.parquet(str(tmp_path / "in" / "documents.parquet"))
    for name in ("labels", "benchmark"):
        queries.table(spark, sf, name).write.parquet(str(tmp_path / "in" / f"{name}.parquet"))
    at = str(tmp_path / "in")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "decontaminate", "secrets", "pack"]
    labels, benchmark = queries.table(spark, at, "labels"), queries.table(spark, at, "benchmark")
    now = queries.table(spark, at, "documents")
    rows = lambda df: sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())

    def advance(name):
        out = cluster.checkpoint(stages[name](spark, now, at))
        assert name == "pack" or out.columns == docs.columns
        return out

    before = rows(now)
    model = toxicity.train_toxicity(now, labels)
    scores = toxicity.score(model, pa.array([t for _, t in before]))
    now = advance("toxicity")
    assert rows(now) == [r for r, s in zip(before, scores, strict=True) if s < 0.5]
    labelled = {r.doc_id for r in labels.filter("toxic = 0").collect()}
    clean = [i for i, _ in before if i in labelled]
    assert len(set(clean) & {i for i, _ in rows(now)}) > 0.97 * len(clean)

    before = rows(now)
    now = advance("near_duplicates")
    kept = {c for _, _, c in jaccard(before)}
    assert rows(now) == [r for r in before if r[0] in kept]

    before = rows(now)
    now = advance("decontaminate")
    bad = {r[0] for r in contamination(before, [(r.item_id, r.text) for r in benchmark.collect()]) if r[5]}
    assert bad and rows(now) == [r for r in before if r[0] not in bad]

    before = rows(now)
    now = advance("secrets")
    for (i, old), (j, new) in zip(before, rows(now), strict=True):
        assert i == j and not brute_secrets(new)
        at_end, rebuilt = 0, ""
        for s, _, e, _ in brute_secrets(old):
            if s >= at_end:
                rebuilt += old[at_end:s] + "[SECRET]"
            at_end = max(at_end, e)
        assert new == rebuilt + old[at_end:] or "login" in old
    assert {r.doc_id: r.n_chars for r in now.collect()} == {i: len(t) for i, t in rows(now)}

    last = advance("pack").collect()
    made, total = check_packing(last, rows(now), packing.SIZE)
    assert made <= total / packing.SIZE * 1.02 + 1
    whole = corpus_pipeline.run(spark, at).collect()
    key = lambda out: collections.Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in out)
    assert key(whole) == key(last)


KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def multiset(rows):
    return collections.Counter((r[0], r[1]) for r in rows)


def kept_rows(rows):
    """One row of each group of linked texts, by comparing every two texts: rows with an id first, then the smallest id, then the smallest key."""
    sets = [grams(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    best = {}
    for (i, t), s, g in zip(rows, sets, group, strict=True):
        if s:
            best[g] = min(best.get(g, (True, 1 << 60, b"~" * 40, "")), (i is None, i or 0, hashlib.md5(t.encode()).digest(), t))
    out = collections.Counter((None if none else i, t) for none, i, _, t in best.values())
    out += collections.Counter({(i, t): 1 for (i, t), s in zip(rows, sets, strict=True) if not s and i is not None})
    return out + collections.Counter((i, t) for (i, t), s in zip(rows, sets, strict=True) if not s and i is None)


def test_stages_on_odd_rows(spark, sf, monkeypatch):
    item = [r.text for r in queries.table(spark, sf, "benchmark").collect() if len((r.text or "").split()) >= 13]
    a, b, c = (long_text(120, k) for k in (1, 2, 3))
    rows = [(None, "no id"), (1, None), (2, ""), (2, ""), (3, "a" * 100_000), (4, a), (4, b), (5, a), (5, c), (5, c), (6, a + " tail"), (None, c + " end"), (None, long_text(90, 7)), (None, long_text(90, 7)), (None, ""), (None, "")]
    rows += [(7, item[0]), (7, "clean under the same id"), (None, item[-1]), (8, long_text(900, 8) + " " + " ".join(item[0].split()[:13])), (9, SECRETS[0]), (9, SECRETS[6]), (None, SECRETS[3])]
    table = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], KINDS)
    stages = dict(corpus_pipeline.STAGES)
    model = toxicity.train_toxicity(table, queries.table(spark, sf, "labels"))
    scores = toxicity.score(model, pa.array([t or "" for _, t in rows]))
    assert multiset(stages["toxicity"](spark, table, sf).collect()) == multiset(r for r, s in zip(rows, scores, strict=True) if s < 0.5)
    assert multiset(stages["near_duplicates"](spark, table, sf).collect()) == kept_rows(rows)
    bench = [(r.item_id, r.text) for r in queries.table(spark, sf, "benchmark").collect()]
    clean = multiset(r for r in rows if not contamination([r], bench)[0][5])
    assert (7, item[0]) not in clean and (7, "clean under the same id") in clean
    for size in (decontamination.BLOCK_BYTES, 4000):
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", size)
        assert multiset(stages["decontaminate"](spark, table, sf).collect()) == clean
    redacted = stages["secrets"](spark, table, sf).collect()
    assert collections.Counter(r.doc_id for r in redacted) == collections.Counter(i for i, _ in rows)
    untouched = multiset(r for r in rows if not brute_secrets(r[1] or "") and not brute_linked(r[1] or ""))
    assert untouched <= multiset(redacted) and not any(brute_secrets(r.text or "") for r in redacted)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in redacted)
    check_packing(stages["pack"](spark, table.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), sf).collect(), [(r.doc_id, r.text) for r in table.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect()], packing.SIZE)
    packed = stages["pack"](spark, table, sf).collect()
    assert collections.Counter(r.doc_id for r in packed if r.piece == 0) == collections.Counter(i for i, _ in rows)
    for name, stage in stages.items():
        out = stage(spark, table.limit(0), sf)
        assert out.count() == 0 and (name == "pack" or out.columns == table.columns)
        assert name == "pack" or stage(spark, table, sf).columns == table.columns
