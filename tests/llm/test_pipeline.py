"""The corpus pipeline, stage by stage, against plain versions."""

from collections import Counter, defaultdict
from itertools import combinations

import corpus_pipeline
import numpy as np
import tiktoken
from pyspark.sql import functions as F

from test_operators import _sets

from mosaiq.llm import bpe, langid, minhash, mixing
from mosaiq.session import written


def test_stages_against_plain_versions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(docs.limit(5)).unionByName(spark.createDataFrame([(10**6, None, None, None, None), (None, "to be or not to be", "en", "src1", 1)], docs.schema))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "near_dedup", "mix_sources", "byte_bpe"]
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, sf))
        out[name] = (before, docs)
        if name != names[-1]:
            assert docs.columns == before.columns
    before, after = out["language_id"]
    parser = langid.fit(before)
    want = []
    for r in before.collect():
        data = np.frombuffer((r["text"] or "").encode(), np.uint8)
        if r["text"] is not None and parser.identify(data, np.array([0, len(data)]))[0][0] is not None:
            want.append(tuple(r))
    assert sorted(want, key=repr) == sorted((tuple(r) for r in after.collect()), key=repr)
    before, after = out["exact_dedup"]
    first = {}
    for r in before.collect():
        i = r["doc_id"] if r["doc_id"] is not None else 1 << 62
        first[r["text"]] = min(first.get(r["text"], i), i)
    assert sorted(first.values()) == sorted(r["doc_id"] if r["doc_id"] is not None else 1 << 62 for r in after.collect())
    before, after = out["near_dedup"]
    # of near pairs, found by comparing all sets of shingles, one document stays in nearly all; of others all do
    rows = [(r["doc_id"], _sets(r["text"])) for r in before.collect() if r["text"] is not None]
    where = defaultdict(list)
    for k, (_, x) in enumerate(rows):
        for y in x:
            where[y].append(k)
    both = Counter(p for ks in where.values() for p in combinations(ks, 2))
    near = [p for p, n in both.items() if n / (len(rows[p[0]][1]) + len(rows[p[1]][1]) - n) >= minhash.THRESHOLD]
    kept = {r["doc_id"] for r in after.collect()}
    assert near and sum(not {rows[a][0], rows[b][0]} <= kept for a, b in near) >= 0.9 * len(near)
    alone = {r[0] for r in rows} - {rows[k][0] for p in near for k in p}
    assert alone <= kept and before.count() - len(kept) <= len(near)
    before, after = out["mix_sources"]
    assert after.select("doc_id").distinct().count() == before.select("doc_id").distinct().count() and after.count() >= before.count()
    due = {r[0]: r[1] for r in mixing.mix_copies(before).groupBy("source").agg(F.sum("expected")).collect()}
    got = {r[0]: r[1] for r in after.groupBy("source").count().collect()}
    assert got.keys() == due.keys() and all(abs(got[k] - due[k]) < 1 for k in due) and abs(sum(got.values()) - sum(due.values())) < 1
    size = {r[0]: r[1] for r in before.groupBy("source").agg(F.sum(F.octet_length("text"))).collect()}
    rows = {r[0]: r[1] for r in before.groupBy("source").count().collect()}
    per = [due[k] / rows[k] * size[k] / size[k] ** 0.7 for k in size]
    assert max(per) < min(per) * (1 + 1e-9)
    before, after = out["byte_bpe"]
    public = tiktoken.Encoding("p", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=bpe.read_ranks(), special_tokens={})
    want = sorted((repr(r["doc_id"]), public.encode_ordinary(r["text"])) for r in before.collect())
    assert want == sorted((repr(r["doc_id"]), r["tokens"]) for r in after.collect())
