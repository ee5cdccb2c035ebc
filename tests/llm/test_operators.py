"""Each operator against a brute-force version, a round trip or held-out accuracy, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionlake.llm import balltree, components, langid, licenses, linededup, media, mixing, ngramjoin, packing, quotes, tokens, tokenstore, words
from sessionlake.llm.common import bounded_sample, ship
from sessionlake.sources import scratch

#: Names that operators give to columns of their own.
CLASHING = ["size", "score", "lines", "component_id", "u", "v", "k", "m", "mean", "whole", "key", "row", "times", "nth", "drop", "kept", "site", "copies", "node", "dealt", "lang_pred", "taken", "h", "n"]
DOCS = ", ".join(["doc_id bigint, text string, lang string, source string, n_chars bigint", *(f"{c} string" for c in CLASHING)])
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


def frame(spark, rows, columns=5):
    extra = ["x"] * len(CLASHING) if columns > 5 else []
    return spark.createDataFrame([(*r, *extra) for r in rows], DOCS if extra else ", ".join(DOCS.split(", ")[:5]))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    long = " ".join(f"word{i % 977}x" for i in range(60_000))
    rows = [(1, None, "en", "a", 0), (2, "", "de", "a", 0), (3, " \n\t ", None, "b", 3), (4, long, "en", "a", len(long)), (5, long, "fr", None, None), (6, "one two", "en", "b", 7), (6, "one two", "en", "b", 7), (7, "12 34 %%", "en", None, 8), (8, "ünïcode çà et là <|endoftext|> x", "fr", "c", 1), (None, "no id at all", "en", "c", 1), (9, "a" * 200_000, "en", "c", 1)]
    return frame(spark, rows, 9)


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])


def twins(n=1024):
    """Two words of n bytes (Thue-Morse and its complement) that polynomial hashes modulo a power of two can't tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def texts(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("the", "ing", "ör", "tion", "é", "st", "ble") for b in ("an", "er", "ou", "ü,", "x.", "")]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 90))) for _ in range(n)]


# -- shared parts ----------------------------------------------------------------------------------


def test_words_are_the_pattern_s_words():
    import pyarrow as pa

    rows = ["", None, "  a\tb\x0bc\nd  ", "é x  y", *texts()]
    data, offsets = words.text_buffer(pa.array(rows, pa.string()))
    starts, ends, first = words.segment(data, offsets)
    raw = data.tobytes()
    for i, text in enumerate(rows):
        assert [raw[s:e].decode() for s, e in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]])] == WORD.findall(text or "")
    found = words.hashes(data, starts, ends)
    assert len({(raw[s:e]) for s, e in zip(starts, ends)}) == len(set(found.tolist()))


def test_encoder_equals_the_library():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = tokens.default_vocabulary()
    rows = ["", None, "It's  A <|endoftext|>Test of ﬁne İ print", "x" * 5000, "a | b|c || | \0\0 \0", " ".join(twins()), " ".join(twins(64)), *texts(2)]
    whole = Tokenizer.from_file(path)
    assert [x.tolist() for x in tokens.encoded(pa.array(rows, pa.string()), path)] == [whole.encode(x or "", add_special_tokens=False).ids for x in rows]


def test_words_with_one_hash_keep_their_own_ids(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = tokens.default_vocabulary()
    whole = Tokenizer.from_file(path)
    real = words.hashes
    monkeypatch.setattr(words, "hashes", lambda data, starts, ends: real(data, starts, ends) % np.uint64(7))
    encoder = tokens.WordEncoder(path)
    for rows in (["one two three four five six seven eight nine ten", *twins()], texts(3), ["ten nine zero | one", "x" * 90]):
        found = [ids[a:b].tolist() for _, ids, sizes in encoder.encode(pa.array(rows)) for a, b in zip(np.cumsum(sizes) - sizes, np.cumsum(sizes))]
        assert found == [whole.encode(x, add_special_tokens=False).ids for x in rows]


def test_samples_are_bounded_whatever_the_ids(spark):
    one = spark.createDataFrame([(7, "same")] * 3000 + [(7, f"t{i}") for i in range(3000)], "doc_id bigint, text string")
    assert 50 < bounded_sample(one, 200).count() < 300 and bounded_sample(one, 6000).count() == 6000
    assert bounded_sample(one.filter("text = 'same'"), 10).count() <= 1


def test_temporary_tables_go(spark):
    import os

    with scratch.temporary(spark) as keep:
        a, b = scratch.stored(spark.range(3)), keep(scratch.stored(spark.range(4)))
    assert not os.path.exists(a.scratch_path) and os.path.exists(b.scratch_path) and b.count() == 4
    scratch.discard(b)
    assert not os.path.exists(b.scratch_path)


def test_components_against_union_find(spark):
    rng = random.Random(3)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)] + [(5, 5)]
    parent = {x: x for pair in links for x in pair}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    found = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert all(found.get(x, x) == find(x) for x in parent)
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# -- 1 ---------------------------------------------------------------------------------------------


def sentences(lang, n, seed):
    rng = random.Random(seed)
    parts = {"en": ["the", "ing", "tion", "wh", "ly"], "de": ["sch", "ung", "keit", "ü", "ein"], "fr": ["eau", "oi", "que", "é", "aux"]}[lang]
    return [" ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(6, 30))) for _ in range(n)]


def test_language_id_on_held_out_rows_and_by_brute_force(spark):
    rows = [(i * 3 + j, t, lang, "s", 1) for j, lang in enumerate(("en", "de", "fr")) for i, t in enumerate(sentences(lang, 60, j))]
    docs = frame(spark, rows)
    names, logs = langid.train(docs.filter("doc_id % 2 = 0"))
    assert names == ["de", "en", "fr"]
    found = {r.doc_id: r for r in langid.predict(docs, (names, logs)).collect()}
    assert np.mean([found[r[0]].lang_pred == r[2] for r in rows if r[0] % 2]) > 0.98
    assert all(0 <= r.score <= 1 for r in found.values())

    # n-grams counted one by one: as many of each kind, and the same posterior
    import pyarrow as pa

    text = "Ab, Çd"
    ((n, kinds, letters),) = list(langid.grams(pa.array([text])))
    plain = "\0ab\0\0çd\0"
    assert (n, letters.tolist()) == (1, [4]) and [len(b) for b, _ in kinds] == [4, sum(plain[i : i + 2] != "\0\0" for i in range(7)), sum(plain[i + 1] != "\0" for i in range(6))]
    both = list(langid.grams(pa.array([text, text])))[0]
    for (one, _), (two, who) in zip(kinds, both[1]):
        assert sorted(two[who == 0]) == sorted(two[who == 1]) == sorted(one)
    total = logs[-1].astype(float) + sum(logs[b].astype(float).sum(0) for b, _ in kinds)
    langs, best = langid.scores(pa.array([text]), names, logs)
    assert langs == [names[total.argmax()]] and math.isclose(best[0], 1 / np.exp(total - total.max()).sum(), rel_tol=1e-9)


def test_language_id_odd_rows(spark, odd, nothing):
    model = langid.train(odd)
    found = langid.predict(odd, model).collect()
    assert len(found) == 11 and {r.doc_id for r in found if r.lang_pred == "und"} == {1, 2, 3, 7}
    assert langid.predict(nothing, langid.train(nothing)).collect() == []
    assert {r.lang_pred for r in langid.predict(odd, ([], np.zeros((9, 0), np.float32))).collect()} == {"und"}


# -- 2 ---------------------------------------------------------------------------------------------


def test_png_round_trip():
    for raw in (b"", b"x", b"y" * 64, bytes(range(256)) * 9, "é".encode() * 1000):
        payload = media.padded(raw)
        assert len(payload) % 64 == 0 and len(payload) > 0 and payload.startswith(raw) and not payload[len(raw) :].strip(b"\0")
        assert media.read_png(media.write_png(payload)) == payload
    with pytest.raises(ValueError):
        media.read_png(media.write_png(bytes(64))[:-20] + b"broken--------------")


def test_html_sequences_keep_positions_and_captions(spark):
    html = "<p>First <b>one</b><figure><img src='sha256:aa' alt='other'><figcaption>A  &amp; B</figcaption></figure>then<img src=sha256:bb alt='only alt'><script>no</script><p>last"
    items = media.parse_items(html)
    assert [(i["position"], i["kind"], i["text"], i["digest"], i["caption"]) for i in items] == [(0, "text", "First one", None, None), (1, "media", None, "aa", "A & B"), (2, "text", "then", None, None), (3, "media", None, "bb", "only alt"), (4, "text", "last", None, None)]
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<img>")], "page_id bigint, html string")
    parsed = media.parse_html(pages)
    known = spark.createDataFrame([("aa", "payload"), ("aa", "payload")], "digest string, value string")
    found = media.resolve(parsed, known)
    assert [(r.position, r.value) for r in found.filter("page_id = 1 and kind = 'media'").orderBy("position").collect()] == [(1, "payload"), (3, None)]
    whole = {r.page_id: r["items"] for r in media.sequences(found, "page_id").collect()}
    assert [i.position for i in whole[1]] == [0, 1, 2, 3, 4] and len(whole[3]) == 1 and 2 not in whole


def test_media_columns_query(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    rows = media.op2_media_columns(spark, str(tmp_path)).collect()
    plain = Counter((r.doc_id, r.text or "") for r in odd.collect())
    assert len(rows) == 11
    for r in rows:
        text = next(t for d, t in plain if d == r.doc_id)
        payload = media.padded(text.encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        form = media.write_png(payload)
        assert (r.media_bytes, r.media_sha256) == (len(form), hashlib.sha256(form).hexdigest())
    assert len({(r.payload_sha256, r.media_sha256, r.feature) for r in rows}) == len({r.payload_sha256 for r in rows})


# -- 3 and 10 --------------------------------------------------------------------------------------


def whole_ids(rows, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_vocabulary())
    return [[*t.encode(x or "", add_special_tokens=False).ids, end] for x in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_store_round_trip(spark, odd, nothing, tmp_path, monkeypatch):
    many = frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate([*texts(4, 698), *twins()])][::-1])
    for name, docs, sample in (("many", many, 300), ("odd", odd, 1000)):
        path = f"{tmp_path}/{name}"
        tokenstore.write(docs, path, sample=sample)
        rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
        ids = whole_ids([r.text for r in rows], 1)
        found = sorted(tokenstore.read(spark, path).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in found] == [r.doc_id for r in rows]
        assert [r.start for r in found] == [0, *np.cumsum([len(x) for x in ids]).tolist()[:-1]]
        assert [np.frombuffer(r.ids, "<u4").tolist() for r in found] == ids
        digests = {(r.doc_id, r.n_tokens, r.ids_crc32) for r in tokenstore.read(spark, path, digest=True).collect()}
        assert digests == {(r.doc_id, len(x), crc(x)) for r, x in zip(rows, ids)}
    assert spark.read.parquet(f"{tmp_path}/many/dictionary").first().dictionary != ""
    wanted = tokenstore.fetch(spark, f"{tmp_path}/many", 17, 699)
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in wanted.collect()} == {17: whole_ids([texts(4, 698)[17]], 1)[0], 699: whole_ids([twins()[1]], 1)[0]}
    assert "LessThanOrEqual(first_id,17)" in wanted._jdf.queryExecution().toString() and tokenstore.fetch(spark, f"{tmp_path}/many", 10**9).collect() == []
    assert len({bytes(r.ids) for r in tokenstore.fetch(spark, f"{tmp_path}/odd", 6).collect()}) == 1 and tokenstore.fetch(spark, f"{tmp_path}/odd", 6).count() == 2
    tokenstore.write(nothing, f"{tmp_path}/none")
    assert tokenstore.read(spark, f"{tmp_path}/none").collect() == []
    same = frame(spark, [(5, "the same text", "en", "s", 1)] * 3000)
    monkeypatch.setattr(tokenstore, "BLOCK_DOCS", 100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tokenstore.write(same, f"{tmp_path}/same")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = tokenstore.read(spark, f"{tmp_path}/same").collect()
    assert sorted(r.start for r in found) == list(range(0, 3000 * found[0].n_tokens, found[0].n_tokens))
    assert spark.read.parquet(f"{tmp_path}/same/blocks").select("shard").distinct().count() > 1


def test_best_fit_and_its_bound():
    rng = random.Random(7)
    for n, top in ((0, 9), (1, 2048), (300, 2048), (300, 700), (50, 1100), (400, 40)):
        lengths = np.sort(np.array([rng.randint(1, top) for _ in range(n)], np.int64))[::-1]
        bins, offsets = packing.best_fit(lengths)
        rooms: list[int] = []  # the plain rule
        for size, own in zip(lengths.tolist(), bins.tolist()):
            fit = min((r for r in rooms if r >= size), default=None)
            if fit is None:
                rooms.append(2048 - size)
            else:
                rooms[rooms.index(fit)] = fit - size
        assert len(set(bins.tolist())) == len(rooms)
        filled = Counter()
        for b, o, size in zip(bins.tolist(), offsets.tolist(), lengths.tolist()):
            assert o == filled[b]
            filled[b] += size
        assert all(f <= 2048 for f in filled.values())
        assert -(-int(lengths.sum()) // 2048) <= packing.lower_bound(lengths) <= len(rooms)
    assert packing.lower_bound(np.array([1100] * 5)) == 5 and packing.lower_bound(np.array([700] * 6)) == 3


def assert_packed(rows, ids):
    """rows: packed pieces; ids: Counter of whole id lists by document."""
    pieces = Counter()
    for doc_id, whole in ids:
        for i, at in enumerate(range(0, len(whole), 2048)):
            pieces[doc_id, i, at, len(whole[at : at + 2048]), crc(whole[at : at + 2048])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == pieces
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    return len(bins)


def test_packing(spark, odd, nothing):
    docs = frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate([*texts(5, 498), *twins()])])
    same = frame(spark, [(5, "one text for all of the rows", "en", "s", 1)] * 2000)
    for own, group in ((docs, 4096), (docs, 40), (odd, 4096), (same, 50)):
        rows = packing.pack(packing.stored(packing.pieces(own)), group=group).collect()
        n = assert_packed(rows, [(r.doc_id, x) for r, x in zip(own.collect(), whole_ids([r.text for r in own.collect()], 0))])
        bound = packing.lower_bound(np.array([r.length for r in rows]))
        assert bound <= n <= bound * 1.05 + 2 or own is same  # groups of 50 of these are far from a full sequence
    assert packing.pack(packing.stored(packing.pieces(nothing))).collect() == []
    groups = packing._round(packing.stored(packing.pieces(same)), 0, 50, 2048).select((F.col("sequence_id") / 2**24).cast("bigint").alias("g")).groupBy("g").count()
    assert groups.count() > 20 and groups.agg(F.max("count")).first()[0] < 200


# -- 4 ---------------------------------------------------------------------------------------------


def plain_targets(sizes, weights, cap=3):
    targets, fixed = {}, set()
    while True:
        rest = sum(sizes.values()) - sum(targets[k] for k in fixed)
        free = {k: weights[k] for k in sizes if k not in fixed}
        targets |= {k: rest * w / sum(free.values()) for k, w in free.items()}
        over = {k for k in free if targets[k] > cap * sizes[k] + 1e-9}
        if not over:
            return targets
        for k in over:
            targets[k] = cap * sizes[k]
        fixed |= over


def test_mix_meets_its_targets(spark):
    rng = random.Random(11)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 60))), "en", rng.choice(["a", "b", "c", "d", None, "é"]) if rng.random() < 0.6 else "hot", 1) for i in range(3000)]
    rows += [(5000 + i, "only one", "en", "tiny", 1) for i in range(3)]
    docs = frame(spark, rows)
    found = mixing.mix(docs).collect()
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(7)).collect()}
    assert {r.doc_id: r.taken for r in found} == again
    size = {r[0]: len(WORD.findall(r[1])) for r in rows}
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += size[r[0]]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = plain_targets(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    taken = Counter()
    for r in found:
        assert (r.size, r.source_size) == (size[r.doc_id], sizes[r.source]) and math.isclose(r.target, targets[r.source], rel_tol=1e-9)
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0) and abs(r.copies - r.rate) < 1 + 1e-9
        taken[r.source] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 60 for s in order)


def test_rates_balance_before_rounding(spark):
    docs = frame(spark, [(i, "w " * (1 + i % 50), "en", "ab"[i % 2], 1) for i in range(400)])
    got = mixing.mix(docs).groupBy("source").agg(F.sum(F.col("rate") * F.col("size")).alias("s"), F.max("target").alias("t")).collect()
    assert all(math.isclose(r.s, r.t, rel_tol=1e-6) for r in got)


def test_mix_odd_rows(spark, odd, nothing):
    rows = mixing.mix(odd).collect()
    assert len(rows) == 11 and all(r.taken <= 3 * r["size"] for r in rows) and {r.taken for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert {r[c] for r in rows for c in ("u", "v", "k", "m", "mean", "whole", "row", "key")} == {"x"}
    assert mixing.mix(nothing).collect() == []


@pytest.mark.parametrize("same", [False, True])
def test_mix_meets_its_targets_without_ids(spark, same):
    text = lambda i: "one two three four five six seven eight nine " + ("ten" if same else f"x{i}")
    docs = frame(spark, [(None if same or i % 2 else 3, text(i), "en", "ab"[i % 3 == 0], 1) for i in range(1500)])
    got = {r.source: r for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()}
    assert len(got) == 2 and all(abs(r.taken - r.target) <= 10 for r in got.values())
    again = {r.source: r.s for r in mixing.mix(docs.repartition(5), keep=["source"], store=True).groupBy("source").agg(F.sum("taken").alias("s")).collect()}
    assert again == {k: r.taken for k, r in got.items()}


def test_solver_ends_by_bisection(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STEPS", 0)
    counts = spark.createDataFrame([(0, i, 3) for i in range(1, 9)], "k int, size bigint, n bigint")
    multiplier = mixing.solve(counts, [{"k": 0, "size": 108, "with_words": 24, "target": 200.0}])[0]
    assert math.isclose(sum(3 * i * 3 / (1 + 2 * math.exp(-multiplier * i / 4.5)) for i in range(1, 9)), 200, rel_tol=1e-8)


# -- 5 ---------------------------------------------------------------------------------------------


#: Headers that the model is not fitted on, as they stand in files.
HEADERS = {
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "GPL-3.0",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.": "GPL-2.0",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.": "LGPL-2.1",
    "Redistribution and use in source and binary forms, with or without modification, are permitted (subject to the limitations in the disclaimer below) provided that the following conditions are met:": "BSD-3-Clause",
    "Licensed to the Foundation under one or more agreements. The Foundation licenses this file to you under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.": "Apache-2.0",
    "Copyright 2020 A. Body. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction": "MIT",
    "Licensed under CC BY-ND 4.0.": "CC-BY-ND-4.0",
    "Licensed under the Zope Public License.": "unknown",
    "Licensed under the Boost Software License.": "unknown",
    "The general public was told that the software is published free by the foundation.": "unknown",
}


def test_license_scan(spark, odd, nothing):
    import textwrap

    rng = random.Random(2)
    rows, truth = [], {}
    for i, text in enumerate(texts(9, 300)):
        family = rng.choice(sorted(licenses.NOTICES)) if i % 3 == 0 else None
        lines = [text[:100], text[100:]]
        if family:
            lines.insert(rng.randrange(3), licenses.NOTICES[family][0])
        truth[i] = family
        rows.append((i, "\n".join(lines), "en", "s", 1))
    filler = " ".join(texts(10, 9))
    wrap = lambda x, mark="": "\n".join(mark + line for line in textwrap.wrap(x, 72))
    for k, (header, family) in enumerate(HEADERS.items()):
        for j, text in enumerate((wrap(header), wrap(header, "# "), f"{filler}\n\n{wrap(header, ' * ')}\n\n{filler}", f"{filler} {header} {filler}")):
            truth[1000 + 10 * k + j] = None if family == "unknown" else family
            rows.append((1000 + 10 * k + j, text, "en", "s", 1))
    truth[2000] = "BSD-3-Clause"  # reserved rights beside a licence
    rows.append((2000, "Copyright (c) 2020 A. Body.\nAll rights reserved.\n\n" + wrap(licenses.NOTICES["BSD-3-Clause"][1]), "en", "s", 1))
    docs = frame(spark, rows)
    model = licenses.train(frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts(8, 300))]))
    found = {r.doc_id: r for r in licenses.scan(docs, model).collect()}
    wrong = [(i, f, found[i].family) for i, f in truth.items() if found[i].family != (f or "unknown")]
    assert not [w for w in wrong if w[1] is None], wrong
    assert len(wrong) <= 0.02 * len(truth) and len([w for w in wrong if w[0] >= 1000]) <= 4, wrong
    hit = next(r for i, r in found.items() if truth[i] == "MIT" and i < 1000)
    assert hit.similarity >= licenses.CONFIRM and licenses.NOTICES["MIT"][0] in rows[hit.doc_id][1].split("\n\n")[hit.paragraph]
    assert len(licenses.scan(odd, licenses.train(odd)).collect()) == 11 and licenses.scan(odd, model).columns[1:3] == ["lang", "source"]
    assert licenses.scan(nothing, licenses.train(nothing)).collect() == []


def test_license_probabilities_by_brute_force():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    weights = rng.normal(size=(1 << 10, 4)).astype(np.float32)
    model = licenses.Model(["a", "b", "c", "unknown"], weights, rng.normal(size=4), 0.7, 0.5)
    text = " ".join(f"W{i % 37}" for i in range(130)) + ".\nnext line\n \nother, paragraph"
    data, offsets = words.text_buffer(pa.array(["", text, None, "one"]))
    data = licenses._FOLD[data]
    units = licenses.Units(data, offsets)
    own = [units.words(data, i) for i in range(len(units.lo))]
    whole = text.lower().replace(".", "").replace(",", "").split()
    expected = [whole[k : k + 48] for k in (0, 24, 48, 72)] + [whole[84:132], ["other", "paragraph"], ["one"]] + [whole[k : k + 24] for k in range(0, 109, 12)] + [["next", "line"]]
    assert [[w.decode() for w in x] for x in own] == expected and units.text.tolist() == [1, 1, 3]
    for x, p in zip(own, model.probabilities(units)):
        one = [int(h) for h in words.hashes(*_flat(x))]
        two = [int(words.mix(np.array([a], np.uint64) * np.uint64(3) + np.array([b], np.uint64))[0]) for a, b in zip(one, one[1:])]
        z = (sum(weights[(g >> 40) % 1024].astype(float) for g in one + two) / math.sqrt(len(one + two)) + model.bias) / 0.7
        assert np.allclose(p, np.exp(z) / np.exp(z).sum())


def _flat(own):
    raw = b" ".join(own)
    ends = np.cumsum([len(w) + 1 for w in own]) - 1
    return np.frombuffer(raw, np.uint8), ends - [len(w) for w in own], ends


# -- 6 ---------------------------------------------------------------------------------------------


def plain_sets(rows):
    out = {}
    for doc_id, text in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out[doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    return out


def plain_components(sets, percent=75):
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


def test_jaccard_components_by_brute_force(spark):
    rng = random.Random(13)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(260):  # one large group of near copies at all similarities, chains, short texts, a common passage
        own = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
            own[rng.randrange(len(own))] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    rows += [(300 + i, " ".join(f"c{k}" for k in range(i * 3, i * 3 + 60))) for i in range(25)]
    passage = " ".join(f"p{k}" for k in range(50))
    rows += [(400 + i, passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.choice([0, 3, 20, 100])))) for i in range(120)]
    rows += [(600 + i, t) for i, t in enumerate(["", None, "one", "ONE", "one two three four", "a b c d e", "a b c d e f", "a b c d e", "x y z"])]
    rows += [(650 + i, f"p q {w} r s t") for i, w in enumerate(twins())]
    whole = [f"big{k}" for k in range(400)]  # excerpts of one long text, alike in groups
    rows += [(700, " ".join(whole))] + [(701 + i, " ".join(whole[i // 6 * 35 : i // 6 * 35 + 60 + i % 6])) for i in range(54)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r for r in ngramjoin.jaccard_components(docs).collect()}
    sets = plain_sets(rows)
    assert {d: r.n_shingles for d, r in found.items()} == {d: len(s) for d, s in sets.items()}
    assert {d: r.component_id for d, r in found.items()} == plain_components(sets)


def test_survey_counts_over_many_fragments_and_parts(spark):
    rng = random.Random(17)
    rows = [(i, " ".join(f"v{rng.randrange(6)}" for _ in range(rng.randrange(40)))) for i in range(150)] + [(200 + i, "the same words in many documents " * 3) for i in range(40)]
    docs = spark.createDataFrame([*rows, (300, None)], "doc_id bigint, text string").repartition(7)
    found = {r.doc_id: (r.n, r.q, r.shared) for r in ngramjoin.survey(docs, 10**8, share=1).collect()}
    sets = plain_sets([*rows, (300, None)])
    times = Counter(g for own in sets.values() for g in own)
    assert found == {d: (len(own), len(own), sum(times[g] > 1 for g in own)) for d, own in sets.items()}


def test_jaccard_odd_rows(spark, odd, nothing):
    rows = odd.collect()
    sets = plain_sets([(i, r.text) for i, r in enumerate(rows)])
    component = plain_components(sets)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[component[i]].append(r.doc_id)
    name = {c: min((d for d in ids if d is not None), default=None) for c, ids in least.items()}
    found = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngramjoin.jaccard_components(odd).collect())
    assert found == Counter((r.doc_id, len(sets[i]), name[component[i]]) for i, r in enumerate(rows))
    assert ngramjoin.jaccard_components(nothing).collect() == []
    kept = ngramjoin.stage_near_copies(spark, odd, "")
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 8, 9] and kept.columns == odd.columns


def test_jaccard_against_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(31)
    base = [[f"v{rng.randrange(40)}" for _ in range(rng.randint(1, 40))] for _ in range(30)]
    rows = []
    for i in range(160):
        own = list(rng.choice(base))
        if rng.random() < 0.6:
            own[rng.randrange(len(own))] = "Z"
        rows.append((rng.choice([i, i, None, 5]), " ".join(own)))
    spark.createDataFrame([*rows, (900, None), (901, " \n")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    found = ngramjoin.op6_ngram_jaccard(spark, str(tmp_path))
    result = duck.execute(ngramjoin.ORACLE)
    names = [d[0] for d in result.description]
    assert Counter(tuple(r[n] for n in names) for r in found.collect()) == Counter(result.fetchall())


# -- 7 ---------------------------------------------------------------------------------------------


def plain_top(queries, rows, k=5):
    out = set()
    for q, v in queries.items():
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v)))[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)}
    return out


def test_top_k_by_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-300, 300, 8).tolist()) for i in range(900)] + [(2000 + i, [7] * 8) for i in range(300)] + [(3000, [1, 2]), (3001, [2, 1]), (3050, [5, 5]), (4000, [2**33] * 8), (4050, [2**33 + 1] * 8), (5000, [])]
    queries = {i: v for i, v in rows if i % 50 == 0}
    columns = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id bigint, v array<double>")
    asked = columns.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    want = {(q, n, i, max(-(2**63), min(2**63 - 1, s))) for q, n, i, s in plain_top(queries, rows)}
    for sizes in ({}, {"shard": 100, "block": 7}):
        found = {tuple(r) for r in balltree.exact_top_k(asked.unionByName(asked), columns, **sizes).collect()}
        assert found == want


def test_top_k_of_rows_that_repeat_an_id_and_of_large_components(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i % 120, (rng.integers(-60, 60, 4) / 64).tolist()) for i in range(300)]
    rows += [(200, [2.0**70, 0.0, 0.0, 0.0]), (250, [0.0, 2.0**56, 0.0, 1.0]), (300, [-(2.0**70), 0.0, 2.0, 0.0])]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    want = Counter()
    for n, (q, v) in enumerate(whole):
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for m, (i, w) in enumerate(whole) if m != n)[:5]
            want.update((q, r + 1, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(scored))
    assert Counter(tuple(r) for r in balltree.op7_ball_tree_topk(spark, str(tmp_path)).collect()) == want


def test_whole_vectors_leaves_out_the_unusable(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.001]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 0.0]), (None, [1.0, 1.0]), (6, [])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert {(r.vec_id, tuple(r.v)) for r in balltree.whole_vectors(table).collect()} == {(1, (128.0, -1.0)), (6, ())}
    empty = balltree.whole_vectors(table.limit(0))
    assert balltree.exact_top_k(empty.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), empty).collect() == []


# -- 8 ---------------------------------------------------------------------------------------------


def test_quote_threads(spark):
    rows = [
        (1, 0, "user", "Hello there\nhow are you"),
        (1, 1, "assistant", "> how are  YOU\nfine"),
        (1, 2, "user", "> > how are you\n> fine\nglad"),
        (1, 3, "user", "another start"),
        (1, 4, "assistant", ">another start\n>not said by anyone\nyes\n"),
        (1, 5, "user", "> > fine\nindeed"),
        (1, 6, "user", "> later words\nx"),
        (1, 7, "user", "later words"),
        (2, 0, None, None),
        (2, None, "user", "> how are you"),
        (None, 3, "user", "> later words"),
        (2, 1, "user", ""),
        (2, 1, "user", ""),
    ]
    messages = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id bigint, turn bigint, role string, text string, lines string, thread string")
    found = {(r.conv_id, r.turn): r for r in quotes.conversations(messages).collect()}
    assert {k: (r.reply_to, r.thread, r.depth) for k, r in found.items() if k[0] == 1} == {(1, 0): (None, 0, 0), (1, 1): (0, 0, 1), (1, 2): (1, 0, 2), (1, 3): (None, 3, 0), (1, 4): (3, 3, 1), (1, 5): (1, 0, 2), (1, 6): (None, 6, 0), (1, 7): (None, 7, 0)}
    assert found[1, 2].text == "glad" and found[1, 2].n_quoted == 2 and found[1, 4].text == "yes\n"
    ordered = quotes.reply_ordered(quotes.conversations(messages)).filter("conv_id = 1").collect()
    assert [r.turn for r in ordered] == [0, 1, 2, 5, 3, 4, 6, 7]
    assert quotes.conversations(messages).count() == len(rows)
    assert quotes.transcript(quotes.conversations(messages).limit(0)).collect() == []


def test_quote_threads_against_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(21)
    said, rows = defaultdict(list), []
    for conv in range(40):
        for turn in range(rng.randint(1, 12)):
            lines = [f"line {rng.randrange(30)}" for _ in range(rng.randint(0, 3))]
            if turn and rng.random() < 0.7:
                quoted = rng.choice(said[conv])
                lines = ["> " + x if not x.startswith(">") else ">" + x for x in quoted.split("\n")][: rng.randint(1, 4)] + lines
            said[conv].append("\n".join(lines))
            rows.append((conv, turn, "user", said[conv][-1]))
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    found = quotes.op8_quote_threads(spark, str(tmp_path))
    result = duck.execute(quotes.ORACLE)
    names = [d[0] for d in result.description]
    assert Counter(tuple(r[n] for n in names) for r in found.collect()) == Counter(result.fetchall())


# -- 9 ---------------------------------------------------------------------------------------------


def boilerplate(n, pages, ratio=linededup.RATIO):
    return n > 1 and n >= ratio * pages and (n >= linededup.LEAST_PAGES or n >= linededup.SURE * pages)


def test_boilerplate_on_small_hosts(spark):
    rows = [(10 * h + i, "\n".join(["menu", *(["twice"] if i < 2 else []), f"own {h} {i}"]), "en", f"h{h}", 1) for h in (1, 2, 4, 8) for i in range(h)]
    found = {(r.source, r.doc_id % 10): r.lines for r in linededup.drop_boilerplate(frame(spark, rows), F.split("text", "\n"), F.col("source")).collect()}
    assert found["h1", 0] == ["menu", "twice", "own 1 0"] and found["h2", 0] == ["own 2 0"] and found["h4", 0] == ["own 4 0"] and found["h8", 0] == ["twice", "own 8 0"]


def test_boilerplate_by_brute_force(spark, odd, nothing):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        site = rng.choice(["a", "b", None, "hot", "hot", "hot"])
        lines = [f"own {rng.randrange(10**6)}" for _ in range(3)] + (["menu"] if rng.random() < 0.5 else []) + (["rare"] if rng.random() < 0.1 else [])
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), "en", site, 1))
    found = {r.doc_id: r for r in linededup.drop_boilerplate(frame(spark, rows), F.split("text", "\n"), F.col("source")).collect()}
    pages, seen = Counter(r[3] or "" for r in rows), Counter((r[3] or "", x) for r in rows for x in set(r[1].split("\n")))
    for i, text, _, site, _ in rows:
        keep = [x for x in text.split("\n") if not boilerplate(seen[site or "", x], pages[site or ""])]
        assert found[i].lines == keep and found[i].n_dropped == len(text.split("\n")) - len(keep)
    odd_rows = linededup.drop_boilerplate(odd, F.split("text", "\n"), F.col("source")).collect()
    assert len(odd_rows) == 11 and {r[c] for r in odd_rows for c in ("drop", "kept", "row", "m")} == {"x"}
    assert linededup.drop_boilerplate(nothing, F.split("text", "\n"), F.col("source")).collect() == []
    stage = linededup.stage_line_dedup(spark, odd, "")
    assert stage.columns == odd.columns and stage.count() == 11


def test_html_lines(spark):
    page = "<html><title>T</title><script>var t='</p>';for(i=0;i<n;i++)</script><style>p{}</style><!-- <p>no --><p>A &amp;amp; B&nbsp; &lt;c&gt;<nav><ul><li><a href='x'>Home</a></li></ul></nav><p>One <b>bold</b>  word<br>two</p>"
    row = spark.createDataFrame([(1, "HTTP://Ex.Ample:80/a?b", page), (2, None, None)], "page_id bigint, url string, html string")
    found = {r.page_id: r for r in linededup.drop_boilerplate(row.select("page_id", linededup.host("url").alias("host"), "html"), linededup.lines_of_html("html"), F.col("host"), tags=True).collect()}
    assert found[1].host == "ex.ample" and found[1].lines == ["T", "A &amp; B <c>", "Home", "One bold word", "two"]
    assert found[2].host == "" and found[2].lines == []
