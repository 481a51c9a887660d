"""Each stage of the corpus pipeline against a plain version on the same input, and on odd inputs."""

import collections
import hashlib

import numpy as np
import pytest
import tiktoken

import corpus_pipeline as p
from quillgraph.llm import bpe, common, quality, secret_scan

from .test_llm import brute_groups, brute_overlaps, frame, prose


def rows(df):
    return [tuple(r[c] for c in p.COLUMNS) for r in df.collect()]


def plain_near_dedup(docs):
    groups = brute_groups([(d[0], d[1]) for d in docs])
    left, seen = [], set()
    for d, (i, n, component) in zip(docs, groups, strict=True):
        if not n or i is None:
            left.append(d)
        elif i == component and component not in seen:
            seen.add(component)
            left.append(d)
    return left


def plain_redaction(spark, docs):
    spans = collections.defaultdict(list)
    for r in secret_scan.scan(docs).where("secret").collect():
        spans[r.doc_id].append((r.start, r.start + r.length))
    out = []
    for d in rows(docs):
        text = d[1]
        for a, b in sorted(spans[d[0]], reverse=True):
            text = text[:a] + secret_scan.MARK + text[b:]
        out.append((d[0], text, d[2], d[3], None if text is None else len(text)))
    return out


def tokens(text):
    raw, pattern = bpe.default_vocabulary()
    ids = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.vocabulary(raw, pattern).ranks, special_tokens={}).encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_stages(spark, sf):
    assert [n for n, _ in p.STAGES] == ["quality", "near_dedup", "decontamination", "secrets", "bpe"]
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    good = common.saved(p.keep_good(spark, docs, sf), "t")
    model = quality.train(quality.features(docs), labels)
    want = [d for d in rows(docs) if model.score(quality.statistics([(d[1] or "").encode()]))[0] >= quality.THRESHOLD]
    assert good.columns == p.COLUMNS and sorted(rows(good), key=str) == sorted(want, key=str) and 0 < len(want) < docs.count()
    kept = common.saved(p.keep_one_of_each_group(spark, good, sf), "t")
    assert sorted(rows(kept), key=str) == sorted(plain_near_dedup(sorted(rows(good))), key=str)
    clean = common.saved(p.drop_leaks(spark, kept, sf), "t")
    items = [(r.item_id, r.text) for r in common.table(spark, sf, "benchmark").collect()]
    leaks = {d for d, _ in brute_overlaps([(d[0], d[1]) for d in rows(kept)], items)}
    assert leaks and sorted(rows(clean), key=str) == sorted((d for d in rows(kept) if d[0] not in leaks), key=str)
    safe = common.saved(p.redact_secrets(spark, clean, sf), "t")
    assert safe.columns == p.COLUMNS and sorted(rows(safe), key=str) == sorted(plain_redaction(spark, clean), key=str)
    last = sorted(map(tuple, p.encode(spark, safe, sf).collect()))
    assert last == sorted((d[0], *tokens(d[1])) for d in rows(safe))
    assert sorted(map(tuple, p.run(spark, sf).collect())) == last


@pytest.fixture(scope="module")
def odd_docs(spark):
    base, secret = prose(1, 60), 'token = "' + "0a1b2c3d" * 5 + '"'
    texts = [(1, base), (1, base), (2, base.upper()), (3, ""), (4, None), (None, base), (None, None), (5, "   \n\t "), (6, prose(2, 20_000)), (7, f"{prose(3, 30)} {secret}"), (7, f"{prose(3, 30)} {secret}"), (8, base + " tail"), (8, prose(4, 50))]
    return common.saved(frame(spark, texts), "odd")  # with further columns of clashing names


def test_odd_inputs_of_stages(spark, sf, odd_docs):
    for _, stage in p.STAGES:
        done = stage(spark, odd_docs, sf)
        assert stage(spark, odd_docs.limit(0), sf).count() == 0
        assert done.columns == (p.COLUMNS if stage is not p.encode else ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    assert sorted(rows(p.keep_one_of_each_group(spark, odd_docs, sf)), key=str) == sorted(plain_near_dedup(sorted(rows(odd_docs), key=lambda d: (d[0] is None, d[0] or 0))), key=str)
    assert p.drop_leaks(spark, odd_docs, sf).count() == odd_docs.count()
    safe = p.redact_secrets(spark, odd_docs, sf).collect()
    assert len(safe) == odd_docs.count() and sum("[SECRET]" in (r.text or "") for r in safe) == 2 and all((r.n_chars is None) == (r.text is None) for r in safe)
    assert sorted((r.n_tokens for r in p.encode(spark, odd_docs, sf).collect())) == sorted(tokens(r.text)[0] for r in odd_docs.select("text").collect())
