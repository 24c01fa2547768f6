"""Each stage of the pipeline against a brute-force version of it on what the stage before kept."""

import hashlib
import itertools
import math
import re
from collections import Counter

import corpus_pipeline
import public_tokenizers
from causeway.llm import packing
from tokenizers import Tokenizer

from tests.llm.test_operators import SF, base_spans


def test_stages(spark, tmp_path):
    rows = [spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        rows.append(docs.collect())
    start, clean, unique, safe, mixed, pieces = rows

    # toxicity: a subset, unchanged; labelled documents mostly right
    assert {r.doc_id: r for r in clean}.items() <= {r.doc_id: r for r in start}.items()
    left = {r.doc_id for r in clean}
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("toxic is not null").collect()
    assert sum((r.doc_id in left) == (r.toxic == 0) for r in labels) >= 0.93 * len(labels)

    # near duplicates: the smallest id of each component
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), r.text or "")) for r in clean]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for w in words]
    label = [r.doc_id for r in clean]
    links = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in range(len(links) + 1):
        before = list(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    assert Counter(unique) == Counter(r for r, c in zip(clean, label, strict=True) if r.doc_id == c)

    # secrets: all documents stay, those without spans as they were, the others without secrets
    before = {r.doc_id: r for r in unique}
    assert sorted(before) == sorted(r.doc_id for r in safe)
    for r in safe:
        if base_spans(before[r.doc_id].text):
            assert "[REDACTED]" in r.text and not base_spans(r.text) and r.n_chars == len(r.text)
        elif "[REDACTED]" not in r.text:
            assert r == before[r.doc_id]

    # mixing: as often as the inverted Poisson distribution says
    size = Counter()
    for r in safe:
        size[r.source] += max(1, len(r.text))
    roots = sum(math.sqrt(n) for n in size.values())
    want = Counter()
    for r in safe:
        rate = math.sqrt(size[r.source]) / roots * sum(size.values()) / size[r.source]
        u = int(hashlib.md5(f"mix-1|{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-rate)
        total = p
        while total <= u:
            k += 1
            p *= rate / k
            total += p
        want[r] += k
    assert Counter(mixed) == +want

    # packing: every token once, no padding
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    n = {r.doc_id: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed}
    lengths, fill = Counter(), Counter()
    for p in pieces:
        lengths[p.doc_id] += p.length
        fill[p.sequence_id] += p.length
    assert lengths == Counter({i: n[i] * c for i, c in Counter(r.doc_id for r in mixed).items()})
    assert all(x <= 4096 and x & (x - 1) == 0 for x in fill.values())


def test_stages_take_hard_rows_and_empty_tables(spark, docs, none, tmp_path):
    """Nulls, repeated rows, ties, very long texts and clashing names go through every stage; so does a table without rows."""
    from pyspark.sql import functions as F

    from tests.llm.conftest import prose

    import random

    long = spark.createDataFrame([(500, prose(random.Random(1), 60_000), "a", "k", 1.5, 7, 1)], docs.schema)
    start = docs.unionByName(long).withColumns({"shuffle_key": F.lit("mine"), "__u": F.lit("own"), "clean": F.lit(None).cast("string"), "found": F.lit(2), "given_score": F.lit(3.0)})
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(10, 48)], "doc_id long, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    sizes = []
    for table in (start, start.limit(0)):
        one = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            stage(spark, one, str(tmp_path)).write.parquet(str(tmp_path / f"{name}-{len(sizes)}"))
            one = spark.read.parquet(str(tmp_path / f"{name}-{len(sizes)}"))
            assert one.columns == start.columns, name
            sizes.append(one.count())
            if sizes[-1]:
                assert one.where("shuffle_key = 'mine' and `__u` = 'own' and clean is null and found = 2 and given_score = 3.0 and score = 1.5 and copy = 7").count() == sizes[-1], name
        sizes.append(corpus_pipeline.STAGES[-1][1](spark, one, str(tmp_path)).count())
    assert all(sizes[:5]) and not any(sizes[5:])
