import base64
import hashlib
import os
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.compare import differences
from tests.llm.cases import awkward, frame
from tidemark.llm import bpe, common, components, decontaminate, license_scan, ngram_join, quality_classifier, quality_rules, queries, secret_ledger, substring_dedup, token_counts, token_files

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
HUB = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, awkward())


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_agrees(spark, name):
    from tests.compare import SMALL

    assert differences(queries.QUERIES[name](spark, SMALL), queries.ORACLES[name]) == []


def test_encoding_and_decoding(spark, docs, reference):
    got = {r["doc_id"]: r for r in bpe.round_trip(docs).collect()}
    for i, text in awkward():
        ids = reference.encode_ordinary(text or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    encoded = bpe.bpe_encode(docs)
    back = {r["doc_id"]: bytes(r["bytes"]) for r in bpe.bpe_decode(encoded).collect()}
    assert back == {i: (t or "").encode() for i, t in awkward()}


def test_token_files(spark, docs, monkeypatch, tmp_path):
    hub = Tokenizer.from_file(HUB)
    more = [(200, "a <|endoftext|>b"), (201, "<|endoftext|><|endoftext|>"), (202, "x" * 70 + " " + "yz" * 40 + "\u3000 .\u2028,a. b,\u00a0c"), (203, " <|endoftext|> end")]
    docs = docs.unionByName(frame(spark, more))
    monkeypatch.setattr(token_files, "FILE_BYTES", 9000)
    got = {r["doc_id"]: r for r in token_files.token_file_digest(docs, HUB, public_tokenizers.PATTERN, f"{tmp_path}/t").collect()}
    files = [pq.read_table(f"{tmp_path}/t/files/{p}") for p in sorted(os.listdir(f"{tmp_path}/t/files")) if p.startswith("part-")]
    assert len(files) > 10 and [i for f in files for i in f["doc_id"].to_pylist()] == sorted(got)
    assert all(len(set(f["file"].to_pylist())) <= 1 for f in files)
    start = 0
    for i, text in [*awkward(), *more]:
        ids = [*hub.encode(text or "", add_special_tokens=False).ids, 0]
        assert (got[i]["start"], got[i]["n_tokens"]) == (start, len(ids))
        assert got[i]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_pieces_of_odd_texts(reference):
    """Texts of odd white space, marks and long words, many at once and through a table that is emptied again and again."""
    import random

    rnd = random.Random(1)
    words = ["a", "Bc", "é", "漢字", "...", ",", ". ", " ", "  ", "\n", "\n\n", "\t", "\u3000", "\xa0", "'s", "don't", "12", "3.5", "\u2009", "\x1c", "\x85", "x" * 70, "e.", "Z,", " q. ", "\r\n", "\u2028", "!"]
    enc = bpe.Encoder(open(RANKS, "rb").read(), public_tokenizers.PATTERN)
    enc.pieces.most = 300
    for _ in range(400):
        texts = ["".join(rnd.choice(words) for _ in range(rnd.randint(0, 40))) for _ in range(rnd.randint(1, 8))]
        ids, counts = enc.pieces.many(texts)
        want = [reference.encode_ordinary(x) for x in texts]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w], texts


def test_variable_length_code_round_trip():
    values = np.array([0, 255, 256, 65_535, 65_536, 1 << 24, (1 << 32) - 1, 7], np.uint32)
    counts = np.array([3, 0, 5])
    control, data = token_files.vbyte_encode(values, counts)
    assert token_files.vbyte_decode(control, data, counts).tolist() == values.tolist()
    assert [len(x) for x in control.to_pylist()] == [1, 0, 2]


def edited(text, edits):
    for s, e, t in sorted(edits, reverse=True):
        text = text[:s] + t + text[e:]
    return text


def test_token_counts_follow_two_batches_of_edits(spark, reference):
    rows = [*awkward(), (9, "one id\nof two texts\none id"), (9, "one id\nof two texts\none id")]
    texts = [(i, t, edited(edited(t or "", token_counts.repeated_lines(t or "")), token_counts.redactions(edited(t or "", token_counts.repeated_lines(t or ""))))) for i, t in rows]
    want = sorted((i, len(reference.encode_ordinary(t or "")), len(reference.encode_ordinary(x))) for i, t, x in texts)
    got = token_counts.recount(frame(spark, rows), token_counts.CLEANING).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["n_tokens_after"]) for r in got) == want
    assert sum(r["n_edits"] > 0 for r in got) == sum((t or "") != x for _, t, x in texts) >= 3


def test_second_batch_of_edits_touches_its_leaves_only(spark, reference):
    import random

    rnd = random.Random(3)
    text = " ".join(rnd.choice(["alpha", "beta,", "gamma.\n", "x  y", "12", "\n"]) for _ in range(3000))
    docs = token_counts.first_versions(frame(spark, [(1, text), (2, "left alone")]))
    trees = common.staged(token_counts.build_trees(docs), "trees")
    for k in range(4):
        at = sorted(rnd.sample(range(len(text) - 40), 5))
        edits = [(a, min(a + rnd.choice([0, 1, 7]), b), rnd.choice(["", " ", "new words", "\n"])) for a, b in zip(at, [*at[1:], len(text)])]  # noqa: B905
        version = docs.filter("doc_id = 1").first()["version"]
        table = spark.createDataFrame([(1, version, [{"start": s, "end": e, "text": t} for s, e, t in edits]), (77, 0, [])], f"doc_id long, version long, edits {token_counts._EDITS}")
        changed = common.staged(token_counts.apply_edits(docs, trees, table), "changed")
        docs, trees = (common.staged(x, "next") for x in token_counts.next_version(docs, trees, changed))
        text = edited(text, edits)
        row = changed.first()
        assert (changed.count(), row["text"], row["n_tokens"], sum(row["leaf_tokens"])) == (1, text, len(reference.encode_ordinary(text)), row["n_tokens"])
        assert row["chars_encoded"] < len(text) / 10 and trees.count() == docs.count() == 2, k


def test_secrets(spark, docs):
    got = {r["doc_id"]: [(f["kind"], f["start"], f["end"]) for f in r["findings"]] for r in secret_ledger.secret_scan(docs)[0].collect()}
    assert got[9] == [("assign", 0, 19), ("access", 24, 46)]
    assert secret_ledger.redacted(awkward()[9][1], [(0, 19), (24, 46), (30, 40)]) == "<SECRET> and <SECRET>"
    assert sum(map(len, got.values())) == 2


def test_ledger_scans_only_new_blobs(spark):
    first = spark.createDataFrame([("a", "token = abcdef12"), ("b", "token = abcdef12"), ("c", "plain")], "path string, text string")
    ledger = common.staged(secret_ledger.scan_new_blobs(first), "ledger")
    assert ledger.count() == 2
    second = first.unionByName(spark.createDataFrame([("a", "secret: zzzzzz99"), ("d", None)], "path string, text string"))
    new = secret_ledger.scan_new_blobs(second, ledger)
    assert new.count() == 2
    both = secret_ledger.join_paths(secret_ledger.addressed(second), ledger.unionByName(new))
    assert {(r["path"], len(r["findings"])) for r in both.collect()} == {("a", 1), ("b", 1), ("c", 0), ("d", 0)}
    old = ledger.withColumn("rule_version", F.lit(0))
    assert secret_ledger.scan_new_blobs(first, old).count() == 2


def brute_components(texts):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            o = len(sets[a] & sets[b])
            if a < b and o and 100 * o >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: (len(s), top(i)) for i, s in sets.items()}


@pytest.mark.parametrize("block", [3, 1024])
def test_ngram_join(spark, docs, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    if block == 3:
        monkeypatch.setattr(components, "FEW", 0)  # by steps instead of in one task
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(docs).collect()}
    assert got == brute_components(awkward())


def near_copies(seed, n=200):
    """Short sets of words from few letters: prefixes end anywhere, sizes differ, own n-grams abound."""
    import random

    rnd = random.Random(seed)
    base = [[rnd.choice("abcdefghijklmnop") + rnd.choice("xyz") for _ in range(60)] for _ in range(4)]
    texts = []
    for i in range(n):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 1, 1, 2, 2, 3, 4])):
            w[rnd.randrange(len(w))] = rnd.choice("qrst") * 2
        texts.append((i, " ".join(w[rnd.randrange(20) :] if rnd.random() < 0.3 else w)))
    return texts


@pytest.mark.parametrize("seed, block, rounds", [(5, 1024, 3), (6, 7, 1), (7, 50, 0)])
def test_ngram_join_of_many_near_copies(spark, seed, block, rounds, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "HUB_ROUNDS", rounds)
    texts = near_copies(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(frame(spark, texts)).collect()}
    assert got == brute_components(texts)


def test_ngram_join_of_repeated_rows_and_of_ids_with_two_texts(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(1, a), (1, a), (1, b), (2, b + " tail"), (3, a + " end"), (3, a + " end"), (4, None), (4, None)]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(frame(spark, rows)).collect())
    assert got == [(1, 36, 1), (1, 36, 1), (1, 36, 1), (2, 37, 1), (3, 37, 1), (3, 37, 1), (4, 0, 4), (4, 0, 4)]


def brute_removed(texts):
    seen, out = set(), {}
    for i, t in sorted(texts):
        raw, reach = (t or "").encode(), 0
        mask = [False] * len(raw)
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                mask[max(k, reach) : k + 100] = [True] * (k + 100 - max(k, reach))
                reach = k + 100
            seen.add(raw[k : k + 100])
        out[i] = bytes(c for c, m in zip(raw, mask, strict=True) if not m)
    return out


@pytest.mark.parametrize("block", [700, 2 << 20])
def test_substring_dedup(spark, docs, block, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK", block)
    got = {r["doc_id"]: bytes(r["kept"]) for r in substring_dedup.substring_dedup(docs).collect()}
    assert got == brute_removed(awkward())


def test_substring_dedup_of_rows_that_share_an_id(spark):
    """Each text is a document of its own, in the order of the hashes of the texts."""
    a, b, c = ("".join(chr(97 + (k * s) % 23) for k in range(300)) for s in (1, 5, 7))
    rows = [(4, a), (7, b + c), (7, a + b), (9, c)]
    place = {t: spark.range(1).select(F.xxhash64(F.lit(t))).first()[0] for _, t in rows}
    order = sorted(rows, key=lambda r: (r[0], place[r[1]]))
    plain = {r["doc_id"]: (r["n_removed"], bytes(r["kept"])) for r in substring_dedup.substring_dedup(frame(spark, [(i, t) for i, (_, t) in enumerate(order)])).withColumn("n_removed", F.size("removed")).collect()}
    got = substring_dedup.substring_dedup(frame(spark, rows)).withColumn("n_removed", F.size("removed")).collect()
    assert sorted((r["doc_id"], r["n_removed"], bytes(r["kept"])) for r in got) == sorted((order[i][0], *x) for i, x in plain.items())


def test_substring_dedup_of_repeated_rows(spark):
    twice = frame(spark, [(1, "q" * 50 + "abc" * 60), (1, "q" * 50 + "abc" * 60), (2, "z" * 120)])
    one = frame(spark, [(1, "q" * 50 + "abc" * 60), (2, "z" * 120)])
    rows = lambda d: {(r["doc_id"], bytes(r["kept"])) for r in substring_dedup.substring_dedup(d).collect()}
    assert rows(twice) == rows(one)


def brute_hits(texts, items):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = defaultdict(set)
    for i, t in items:
        w = find(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(i)
    out = {}
    for i, t in texts:
        w, hit, held = find(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    held |= own
                    hit |= set(range(k, k + n))
        out[i] = (len(w), len(hit), held)
    return out


@pytest.mark.parametrize("block", [200, 1 << 24])
def test_decontamination(spark, docs, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
    long = awkward()[20][1]
    items = [(1, None), (2, ""), (3, "one"), (4, long), (5, " ".join(long.split()[3:15])), (6, long), (7, "nowhere to be found " * 4), (None, "two words"), (None, long), (4, "two")]
    table = spark.createDataFrame(items, "item_id long, text string")
    twice = docs.unionByName(docs.filter("doc_id = 20"))  # a repeated row has its row, whatever the number of blocks
    got = decontaminate.contamination(twice, table).collect()
    assert len(got) == len(awkward()) + 1 and all(len(r["items"]) == len(set(r["items"])) for r in got)
    want = brute_hits(awkward(), items)
    assert {r["doc_id"]: (r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), set(r["items"])) for r in got} == want
    names = spark.createDataFrame([(None if i is None else f"item-{i}", t) for i, t in items], "item_id string, text string")
    got = decontaminate.contamination(docs, names).collect()
    assert {r["doc_id"]: set(r["items"]) for r in got} == {d: {None if i is None else f"item-{i}" for i in held} for d, (_, _, held) in want.items()}
    assert decontaminate.without_spans("a b, c d.", [(1, 3)]) == "a  d."


def test_quality_base_counts(spark, docs):
    for r in quality_rules.quality_rules(docs).collect():
        text = dict(awkward())[r["doc_id"]] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = defaultdict(list)
        for k in range(len(w) - 7):
            grams[tuple(w[k : k + 8])].append(k)
        repeated = {k + j for at in grams.values() if len(at) > 1 for k in at for j in range(8)}
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(repeated))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(repeated) > 30 * len(w))


def test_frequent_lines_deplete_documents(spark):
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(25))
    line = " ".join(f"subscribe{k}" for k in range(60))
    texts = [(i, f"{line}\n{body(i)[:40]}") for i in range(8)] + [(i, body(i)) for i in range(8, 12)] + [(i, f"{line}\n{body(0)[:40]}") for i in range(20, 24)]
    rows = frame(spark, texts).withColumn("source", F.lit("h"))
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(rows, max_docs=5).collect()}
    assert kept == {i: i == 0 or 8 <= i < 12 for i in kept}
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(rows, max_docs=5, keep_first=False).collect()}
    assert kept == {i: 8 <= i < 12 for i in kept}


def test_classifier_on_held_out_labels(spark):
    from tests.compare import SMALL

    d, labels = common.documents(spark, "/root/testdata/sf0.01"), common.documents(spark, "/root/testdata/sf0.01", "labels")
    got = quality_classifier.quality_scores(d, labels.filter("doc_id % 3 <> 0")).join(labels.filter("doc_id % 3 = 0"), "doc_id")
    right, n = got.agg(F.avg((F.col("kept").cast("int") == F.col("quality")).cast("int")), F.count(F.lit(1))).first()
    assert n > 80 and right > 0.93
    assert quality_classifier.quality_scores(common.documents(spark, SMALL), labels.limit(0)).agg(F.countDistinct("score")).first()[0] == 1


def test_co_training_equals_one_process(spark):
    """Rounds, choice of pseudo-labels and scores, against the same steps over all rows in one process."""
    import pyarrow as pa

    q, plain = quality_classifier, lambda x: None if x != x else x
    rows = common.documents(spark, "/root/testdata/sf0.01").limit(700).toPandas().sort_values("doc_id").reset_index(drop=True)
    rows = rows.astype(object)
    rows.loc[3, ["text", "lang", "n_chars"]] = None
    docs = spark.createDataFrame([tuple(plain(x) for x in r) for r in rows.to_numpy().tolist()], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(docs.filter("doc_id % 50 = 1"))  # repeated rows train once
    labels = common.documents(spark, "/root/testdata/sf0.01", "labels")
    text = pa.array([plain(t) for t in rows["text"]], pa.string())
    views = q.text_view(text), q.meta_view(text, *([plain(x) for x in rows[c]] for c in ("lang", "source", "n_chars")))
    keys = spark.createDataFrame(list(zip(rows["doc_id"].tolist(), text.to_pylist(), strict=True)), "doc_id long, text string").select("doc_id", F.xxhash64("doc_id", F.lit(9)).alias("by"), F.xxhash64("doc_id", common.body_of(), F.lit(9)).alias("tie")).toPandas().sort_values("doc_id")
    good = dict(labels.groupBy("doc_id").agg(F.min("quality")).collect())
    known = sorted((i for i in range(len(rows)) if rows["doc_id"][i] in good), key=lambda i: rows["doc_id"][i])
    y = np.array([good[rows["doc_id"][i]] for i in known], float)
    held, prior = np.arange(len(y)) % 4 == 3, (y.sum() + 1) / (len(y) + 2)
    sets = [[v[known][~held], y[~held]] for v in views]
    free, tie = {0: set(range(len(rows))) - set(known), 1: set(range(len(rows))) - set(known)}, keys["tie"].to_numpy()
    for _ in range(2):
        p = [q._sigmoid(q.logit(q.fit(*s), v)) for s, v in zip(sets, views, strict=True)]
        for teacher in (0, 1):
            pick = []
            for label, share in ((1.0, prior), (0.0, 1 - prior)):
                sure = p[teacher] if label else 1 - p[teacher]
                best = sorted((i for i in free[teacher] if sure[i] > 0.95), key=lambda i: (-sure[i], tie[i]))[: max(1, int(20 * share))]
                pick += [(i, label) for i in best]
            free[teacher] -= {i for i, _ in pick}
            pick.sort()
            sets[1 - teacher][0] = np.vstack([sets[1 - teacher][0], views[1 - teacher][[i for i, _ in pick]]])
            sets[1 - teacher][1] = np.concatenate([sets[1 - teacher][1], [label for _, label in pick]])
    model = q.finish(tuple(v[known][held] for v in views), y[held], q.fit(*sets[0]), q.fit(*sets[1]), prior)
    want = dict(zip(rows["doc_id"], model.score(*views)[2], strict=True))
    got = q.quality_scores(docs, labels, rounds=2, per_round=20).collect()
    assert len(got) == docs.count()
    assert max(abs(r["score"] - want[r["doc_id"]]) for r in got) < 1e-6


def scanned(spark, texts):
    return {r["doc_id"]: [(x["place"], x["width"], x["family"]) for x in r["licences"]] for r in license_scan.license_scan(frame(spark, texts)).collect()}


def test_licences(spark):
    texts = [(1, "Released under the MIT License.\nplain words"), (2, "the license fee went up\nAll rights reserved."), (3, None), (4, "Licensed under CC BY-NC 4.0.\n" * 2), (5, "This work is licensed under the GNU General Public License, version 3.")]
    texts += [(6, "x\n# SPDX-License-Identifier: MIT\ny"), (7, "// Copyright (c) 2020 Foo Inc."), (8, "Use of this source code is governed by a BSD style"), (9, "he asked for a permission\nand the driver must carry a license")]
    texts += [(10, "Permission is hereby granted, free of charge, to any\nperson obtaining a copy of this software and more"), (11, "Permission is hereby granted, free of\n\ncharge to nobody at all or so he said and then left")]
    got = scanned(spark, texts)
    assert got == {
        1: [(0, 1, "mit")], 2: [(1, 1, "proprietary")], 3: [], 4: [(0, 1, "cc-by-nc"), (1, 1, "cc-by-nc")], 5: [(0, 1, "gpl")], 6: [(1, 1, "mit")], 7: [(0, 1, "copyright-notice")], 8: [(0, 1, "bsd")], 9: [],
        10: got[10], 11: got[11],
    }
    assert {f for _, _, f in got[10]} == {"mit"} and got[10][0][0] == 0


#: Headers as they stand in published files, with their families; none is a template.
HEADERS = [
    (["apache"], "Apache-2.0"), (["apache"], "License: Apache-2.0"), (["mit"], "MIT License"), (["copyright-notice"], "(c) 2021 Foo"), (["cc-by"], "CC-BY-SA 3.0"),
    (["mit"], 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR'), (["epl"], "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    (["isc"], "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that"), (["apache", "mit"], "Apache-2.0 OR MIT"),
    (["apache", "mit"], "This crate is distributed under the terms of both the MIT license and the Apache License (Version 2.0)."), (["lgpl"], "// SPDX-License-Identifier: LGPL-2.1-or-later"),
    (["agpl"], " * it under the terms of the GNU Affero General Public License as published by"), (["gpl"], "# This file is released under the GNU General Public License v2."), (["mpl"], "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. */"),
    (["bsd"], "// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file."), (["apache"], "# you may not use this file except in compliance with the License."),
    (["bsd"], "BSD 3-Clause License"), (["gpl"], "license = GPL-3.0-or-later"), (["copyright-notice"], "Copyright (c) 2014-2019 The Bar Project Developers"), (["proprietary"], "ACME Corp. All Rights Reserved."),
    (["public-domain"], "This is free and unencumbered software released into the public domain."), (["cc-by-nc"], "This dataset is licensed under CC BY-NC-SA 4.0"),
]
CLEAN = [
    "in the all rights reserved meeting and he said all rights reserved to the driver", "he asked for a permission", "the license fee went up", "she went to a public library with a copy of the software catalogue",
    "the general public is asked to use the side door", "no warranty was given for the used car", "the terms of the loan were made available in writing", "a free copy of the program was left on every seat",
]


def test_headers_that_are_not_templates(spark):
    got = scanned(spark, [(i, t) for i, (_, t) in enumerate(HEADERS)] + [(100 + i, t) for i, t in enumerate(CLEAN)])
    missed = [(want, t, got[i]) for i, (want, t) in enumerate(HEADERS) if not set(want) <= {f for _, _, f in got[i]}]
    false = [(t, got[100 + i]) for i, t in enumerate(CLEAN) if got[100 + i]]
    named = [f in want for i, (want, _) in enumerate(HEADERS) for _, _, f in got[i]]
    assert len(missed) <= 0.1 * len(HEADERS), missed
    assert not false
    assert sum(named) >= 0.9 * len(named)


def test_recall_on_wordings_not_trained_on(spark):
    """Templates with other words around them, wrapped at other places, in capitals, with comment marks."""
    cases = []
    for family, own in sorted(license_scan.TEMPLATES.items()):
        for k, s in enumerate(own):
            w = s.replace("year", "2013").split()
            half = len(w) // 2
            cases += [(family, f" * {s.replace('year', '1999').upper()}."), (family, f"zork blim {' '.join(w)} quux trapp")]
            if len(w) > 6:
                cases += [(family, f"# {' '.join(w[:half])}\n# {' '.join(w[half:])}"), (family, " ".join(w[1:]))]
    got = scanned(spark, [(i, f"unrelated words first\n\n{t}\n\nand some last") for i, (_, t) in enumerate(cases)])
    right = [any(f == family for _, _, f in got[i]) for i, (family, _) in enumerate(cases)]
    assert len(cases) > 120 and sum(right) >= 0.9 * len(right), [c for c, ok in zip(cases, right, strict=True) if not ok]


def test_scores_of_licences_by_brute_force(spark):
    """Every paragraph scored without bounds, softmax, threshold, confirmation and overlaps, step by step in Python."""
    m = license_scan
    ordinary = [f"{s} {t}" for s, t in zip(m.ALIKE, m.IN_PASSING, strict=False)]
    lines = [x for i, t in enumerate(x for own in m.SENTENCES.values() for x in own) for x in (t, f"{t}, and {m.ALIKE[i % 16]}", ordinary[i % 12], (" ... ", "zork blim", "plain (1999) -x- a.-b.")[i % 3])]
    docs = m.literal_table(spark, [{"doc_id": i, "body": i, "text": "\n".join(lines[i * 9 : i * 9 + 9])} for i in range(len(lines) // 9)], "doc_id:long,body:long,text:string")
    model = m.train(spark, m.literal_table(spark, [{"line": "it was an ordinary day"}, {"line": "nobody came"}], "line:string"))
    bounds = m.gains(model)
    assert bounds and m.paragraphs(docs, bounds).count() < m.paragraphs(docs).count()
    got = {(r["doc_id"], r["place"], r["width"], r["family"]): r["probability"] for r in m.classify(m.paragraphs(docs, bounds), model).collect()}
    row = {g: i for i, g in enumerate(model.grams)}
    weights, starts, none, found = model.weights, model.intercepts, model.families.index(m.UNKNOWN), {}
    for i in range(len(lines) // 9):
        own = [[w for x in re.sub(r"\b(19|20)\d\d\b", "year", re.sub("[^a-z0-9.+-]+", " ", t.lower())).split() if (w := x.strip(".+-"))] for t in lines[i * 9 : i * 9 + 9]]
        for place in range(9):
            for width in range(1, 1 + min(m.WIDEST, 9 - place)):
                if not all(own[place : place + width]):
                    continue
                t = [w for x in own[place : place + width] for w in x]
                grams = {" ".join(t[k : k + n]) for n in (1, 2, 3) for k in range(len(t) - n + 1)}
                p = m._softmax((starts + sum((weights[row[g]] for g in grams if g in row), np.zeros(len(starts)))).tolist(), model.temperature)
                if 1 - p[none] < model.least:
                    continue
                pairs = {" ".join(t[k : k + 2]) for k in range(len(t) - 1)}
                for family, q in zip(model.families, p, strict=True):
                    if family == m.UNKNOWN or q < m.MINOR:
                        continue
                    for s in m.TEMPLATES[family]:
                        n = len((pairs | set(t)) & set(m.pairs_of(s)))
                        if (n >= m.SHARED * len(m.pairs_of(s)) or (n >= 2 and n >= m.SHARED * len(pairs))) and (len(s.split()) >= m.SHORT or 4 * len(s.split()) >= len(t)):
                            found[i, place, width, family] = q
    rank = lambda k: (k[2], -found[k], k[1])
    beaten = {k for k in found for o in found if o != k and o[0] == k[0] and o[3] == k[3] and o[1] < k[1] + k[2] and k[1] < o[1] + o[2] and rank(o) < rank(k)}
    assert set(got) == set(found) - beaten and len(got) > 40
    assert all(abs(p - found[k]) < 1e-9 for k, p in got.items())


def test_empty_tables(spark):
    none = frame(spark, [(0, "x")]).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    for out in (
        secret_ledger.secret_scan(none)[0],
        token_files.token_file_digest(none, HUB, public_tokenizers.PATTERN),
        substring_dedup.substring_dedup(none),
        decontaminate.contamination(none, bench),
        license_scan.license_scan(none),
        bpe.round_trip(none),
        token_counts.recount(none, token_counts.CLEANING),
        ngram_join.ngram_components(none),
        quality_classifier.quality_scores(none, labels),
        quality_rules.quality_rules(none),
    ):
        assert out.count() == 0


def test_rows_without_doc_id_are_left_out(spark):
    rows = frame(spark, [(1, "some words here"), (None, "some words here")])
    assert ngram_join.ngram_components(rows).count() == bpe.round_trip(rows).count() == secret_ledger.secret_scan(rows)[0].count() == 1


def test_repeated_rows_are_reported_each(spark):
    """Rows that repeat, and ids of two texts: every operator gives a row for each, the same for the same row."""
    long = " ".join(f"word{k}" for k in range(30))
    rows = [(1, long), (1, long), (1, "token = abcdef12 " + long[::-1]), (2, None), (2, None), (3, "")]
    table, bench = frame(spark, rows), spark.createDataFrame([(1, long)], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    for out in (
        secret_ledger.secret_scan(table)[0],
        token_files.token_file_digest(table, HUB, public_tokenizers.PATTERN),
        decontaminate.contamination(table, bench),
        license_scan.license_scan(table),
        bpe.round_trip(table),
        token_counts.recount(table, token_counts.CLEANING),
        ngram_join.ngram_components(table),
        quality_classifier.quality_scores(table, labels),
        quality_rules.quality_rules(table),
    ):
        got = [tuple(r[c] for c in out.columns if c != "start") for r in out.collect()]
        assert len(got) == 6, out.columns
        assert len({str(x) for x in got}) <= len(set(rows)), (out.columns, got)


@pytest.mark.parametrize("row_bytes", [1, 1 << 40, None])
def test_attach_with_and_without_a_broadcast(spark, row_bytes):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "c")], "k long, x string")
    right = common.staged(spark.createDataFrame([(2, 5), (3, 6)], "k long, y int"), "right")
    assert sorted(map(str, (tuple(r) for r in common.attach(left, right, "k", row_bytes).collect()))) == ["(1, 'a', None)", "(2, 'b', 5)", "(2, 'b', 5)", "(None, 'c', None)"]
    assert common.attach(left, right, "k", row_bytes, "left_anti").count() == 2
