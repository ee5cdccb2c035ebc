"""Operators 11 to 13 against brute force, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from sessionlake.llm import alignment, queries, spelling, substrings
from sessionlake.llm.common import ship

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, h string, key string, word string, id string, n string, ranges string, text_key string, link string, copies string"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


def frame(spark, rows):
    return spark.createDataFrame([(*r, *"abcdefghi") for r in rows], DOCS).repartition(3)


@pytest.fixture(scope="session")
def rows():
    """Copies, near copies, shared passages, nulls, empty and long texts, repeated rows, repeated and null ids."""
    rng = random.Random(5)
    vocabulary = [a + b for a in ("color", "center", "straße", "naïve", "Theatre", "label", "grey", "xxyyx") for b in ("", "s", "ed", "ing", "r", "x", "é")]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, base = words(70), words(160)
    out = [(i, " ".join(words(rng.randint(0, 120)))) for i in range(30)]
    out += [(100 + i, " ".join(words(9) + passage + words(11))) for i in range(12)]
    for i in range(25):
        own = list(base)
        own[rng.randrange(len(own))] = f"edit{i}"
        out.append((200 + i, "\n".join(own)))
    out += [(300 + i, " ".join(base)) for i in range(10)] + [(309, " ".join(base))] * 3
    long = " ".join(words(9000))
    return out + [(400, None), (401, ""), (402, " \t\n "), (403, long), (404, long + " end"), (None, long), (None, None), (405, "same " * 400), (406, "same " * 300), (5, " ".join(base)), (407, "é▁ <s> <|endoftext|>  x y ́ ﬁ"), (408, "b" * 3000), (409, "one  two\x1cthree 's don't <0x41> "), (410, "中文 \U0001f600 text")]


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def brute_windows(rows, k):
    first = {}
    split = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - k + 1 if d is not None else 0):
            key = tuple(w[i : i + k])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, w in split:
        gone = {j for i in range(len(w) - k + 1 if d is not None else 0) if first[tuple(w[i : i + k])] < d for j in range(i, i + k)}
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("k", "gram", "hot"), [(50, 8, 20_000), (50, 8, 3), (7, 3, 5), (7, 1, 2)])
def test_super_kmers(spark, rows, k, gram, hot):
    docs = frame(spark, rows)
    assert values(substrings.kept(docs, substrings.removed(docs, k, gram, hot))) == brute_windows(rows, k)


def test_super_kmers_cover_each_window_once_across_pieces():
    rng = random.Random(2)
    own = [rng.choice("abc") * rng.randint(1, 5) for _ in range(700)]
    raw = "\t ".join(own).encode()
    for size in (1, 40, 300, 1 << 20):
        found = [(i + j, part) for _, i, n, packed in substrings.cut(raw, 10, 3, size) for j, part in enumerate(b" ".join(packed.split()[j : j + 10]) for j in range(n))]
        assert found == [(i, " ".join(own[i : i + 10]).encode()) for i in range(691)]


def test_windows_with_one_hash_are_told_apart(monkeypatch):
    import numpy as np

    monkeypatch.setattr(substrings, "_run_hashes", lambda h, size: np.zeros(len(h) - size + 1, np.uint64))
    string, place, gone = substrings._earlier([b"a b c d", b"b c d x", b"z b c"], np.array([1, 2, 3]), 3)
    assert list(zip(string.tolist(), place.tolist(), gone.tolist())) == [(0, 0, False), (0, 1, False), (1, 0, True), (1, 1, False), (2, 0, False)]


def test_repeated_rows_and_hot_ids_are_judged_once(spark):
    text = " ".join(f"w{i}" for i in range(60))
    found = values(substrings.kept(d := frame(spark, [(1, text)] * 40 + [(2, text)] * 40 + [(2, text + " z")]), substrings.removed(d)))
    assert Counter(r[:3] for r in found) == {(1, 60, 0): 40, (2, 60, 60): 40, (2, 61, 60): 1}


def brute_words(rows):
    counts = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    near = defaultdict(set)
    by = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            by[w[:i], w[i + 1 :]].add(w)
            if (v := w[:i] + w[i + 1 :]) in n:
                near[w].add(v), near[v].add(w)
    for group in by.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted(((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n), key=repr)


def test_spelling_variants(spark, rows):
    rng = random.Random(3)
    typos = [(1000 + i, " ".join(w[:j] + rng.choice(["", "e", "ß", w[j:]]) + w[j + 1 :] for w in (rng.choice(["Committee", "aaaaab", "necessary", "occurred", "étagère"]) for _ in range(60)) for j in [rng.randrange(len(w))])) for i in range(40)]
    chain = "lantern " * 24 + "lanterm " * 10 + "lancerm " * 4
    rows = rows + typos + [(2000, "y" * 5000 + " " + "y" * 5001)] * 3 + [(3000, chain)]
    found = spelling.variants(frame(spark, rows))
    assert values(found) == brute_words(rows)
    assert found.filter("form is not null and root <> form").count() > 0


def test_numbers_mean_the_same_node_in_all_tasks(spark):
    """Words dealt over many tasks, most of them with beginnings that other tasks have too."""
    words = sorted({"ab" * i + c for i in range(40) for c in ("", "a", "b", "c", "ca")} - {""})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = spelling.numbered(spark.createDataFrame([(w,) for w in words], "word string"), "word", "id", "nodes").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r.id >> spelling.PLACES for r in found}) > 1
    node = {}
    for r in found:
        for i, x in enumerate(r.nodes):
            assert node.setdefault(r.word[: i + 1], x) == x
    assert len(set(node.values())) == len(node)
    assert [r.word for r in sorted(found, key=lambda r: r.id)] == words


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = alignment.paths()
    first, second = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
    first.encode_special_tokens = True
    letters = alignment.byte_letters()

    def one(text):
        if not text:
            return None
        x, y = first.encode(" " + text, add_special_tokens=False), second.encode(text)
        xs = [bytes(letters[c] for c in t) for t in x.tokens]
        ys = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, second.id_to_piece(i)) for i in y)]
        if not b"".join(xs) == b"".join(ys) == (" " + text).encode():
            return None
        ends, others = ([len(b"".join(t[: i + 1])) for i in range(len(t))] for t in (xs, ys))
        groups, links, i, j = [], [], 0, 0
        for e in sorted({*ends} & {*others}):
            k, m = ends.index(e) + 1, others.index(e) + 1
            groups.append(",".join(map(str, x.ids[i:k])) + "|" + ",".join(map(str, y[j:m])))
            links.append((x.ids[k - 1], y[m - 1]))
            i, j = k, m
        return len(xs), len(ys), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()

    found = [(d, one(t)) for d, t in rows]
    total = Counter(p for _, f in found if f for p in f[3])
    best = defaultdict(int)
    for (_, y), n in total.items():
        best[y] = max(best[y], n)
    return sorted(((d, 0, 0, 0, 0, 0, 0, "") if f is None else (d, *f[:3], len(f[3]), sum(total[p] == best[p[1]] for p in f[3]), sum(total[p] for p in f[3]), f[4]) for d, f in found), key=repr)


def test_alignment(spark, rows, monkeypatch):
    rows = [r for r in rows if len(r[1] or "") < 20_000] + [(7000, rows[33][1] + " x" * 50)]
    assert values(alignment.align(frame(spark, rows))) == brute_alignment(rows)


def test_alignment_in_stretches_and_with_few_units_known(rows, monkeypatch):
    monkeypatch.setattr(alignment, "STRETCH", 64)
    monkeypatch.setattr(alignment, "KEPT", 20)
    own = alignment.Aligner(*alignment.paths())
    texts = [t for _, t in rows if t and len(t) < 20_000]
    plain = {r[0]: r for r in brute_alignment(list(enumerate(texts)))}
    for i, text in enumerate(texts):
        n_a, n_b, n_groups, digest, links = own.align(text)
        assert (n_a, n_b, n_groups, links.total(), digest) == (*plain[i][1:5], plain[i][7])


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_super_kmers", "op13_token_alignment"])
def test_queries_on_tables_without_rows_and_with_odd_rows(spark, rows, name, tmp_path):
    brute = {"op11_spelling_variants": brute_words, "op12_super_kmers": lambda r: brute_windows(r, 50), "op13_token_alignment": brute_alignment}[name]
    some = [r for r in rows if len(r[1] or "") < 20_000]
    for i, own in enumerate(([], some)):
        frame(spark, own).write.parquet(f"{tmp_path}/{i}/documents.parquet")
        found = queries.QUERIES[name](spark, f"{tmp_path}/{i}")
        assert values(found) == brute(own)
