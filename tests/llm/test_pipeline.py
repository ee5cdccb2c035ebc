"""The pipeline against a plain version of each stage."""

import math
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
from sessionlake.llm import linededup
from test_operators import WORD, assert_packed, boilerplate, frame, odd, plain_components, plain_sets, plain_targets, shipped, whole_ids  # noqa: F401

PARTS = {"en": ["the", "ing", "tion", "wh", "ly"], "de": ["sch", "ung", "keit", "ü", "ein"], "fr": ["eau", "oi", "que", "é", "aux"]}


def documents():
    rng = random.Random(17)
    word = lambda lang: "".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 3)))
    rows = []
    for i in range(240):
        lang, source = rng.choice(sorted(PARTS)), rng.choice(["hot", "hot", "a", "b", None])
        lines = [" ".join(word(lang) for _ in range(rng.randint(3, 25))) for _ in range(rng.randint(1, 5))]
        if rng.random() < 0.5:
            lines.insert(rng.randrange(len(lines) + 1), f"menu of {source} {lang}")
        rows.append([i, "\n".join(lines), lang if rng.random() < 0.9 else None, source, 1])
    for i in range(60):  # exact and near copies
        text = rows[rng.randrange(240)][1].split(" ")
        for _ in range(rng.choice([0, 0, 1, 2])):
            text[rng.randrange(len(text))] = "zzz"
        rows.append([300 + i, " ".join(text), "en", rng.choice(["a", "hot"]), 1])
    rows += [[400, None, "en", "a", 0], [401, "12 %% 34", "en", "b", 1], [402, "", None, None, 0]]
    return [tuple(r) for r in rows]


def naive_bayes(rows):
    """Language of each text by counts of its 1- to 3-grams in a dictionary."""

    def grams(text):
        plain = "\0" + "".join(c.lower() if c.isalpha() else "\0" for c in text or "") + "\0"
        for k in (1, 2, 3):
            for i in range(len(plain) - k + 1):
                g = plain[i : i + k]
                if (g[1] if k == 3 else g.strip("\0")) not in ("", "\0"):
                    yield g

    counts, docs = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        if lang:
            docs[lang] += 1
            counts[lang].update(grams(text))
    out = {}
    for doc_id, text, *_ in rows:
        own = Counter(grams(text))
        if own:
            total = {}
            for lang in sorted(docs):
                size = sum(counts[lang].values()) + 0.5 * (1 << 16)
                total[lang] = math.log(docs[lang] / docs.total()) + sum(n * math.log((counts[lang][g] + 0.5) / size) for g, n in own.items())
            best = max(total.values())
            out[doc_id] = 1 / sum(math.exp(t - best) for t in total.values())
    return out


def without_boilerplate(rows):
    clean = lambda text: [x for x in (re.sub(r"[ \t\r\f]+", " ", x).strip(" ") for x in text.split("\n")) if x]
    pages, seen = Counter(r[3] or "" for r in rows), Counter((r[3] or "", x) for r in rows for x in set(clean(r[1])))
    listed = lambda seen: {(s, x) for (s, x), n in seen.items() if boilerplate(n, pages[s], linededup.STAGE_RATIO)}
    common, size = listed(seen), lambda lines: sum(len(x.split(" ")) for x in lines)
    told = Counter()  # only on documents with enough words of their own
    for r in rows:
        site, own = r[3] or "", clean(r[1])
        if size([x for x in own if (site, x) not in common]) > linededup.LEAST_OWN * size(own):
            told.update((site, x) for x in set(own) if (site, x) in common)
    common = listed(told)
    out = []
    for doc_id, text, lang, source, _ in rows:
        site = source or ""
        keep = [x for x in clean(text) if (site, x) not in common]
        new = "\n".join(keep) if len(keep) < len(clean(text)) else text
        out.append((doc_id, new, lang, source, len(new)))
    return out


def test_pipeline_by_brute_force(spark, tmp_path):
    rows = documents()
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    score = naive_bayes(rows)
    kept = [r for r in rows if score.get(r[0], 0) >= 0.5]
    assert {400, 401, 402}.isdisjoint(r[0] for r in kept) and len(kept) >= 295
    kept = without_boilerplate(kept)
    component = plain_components(plain_sets([(r[0], r[1]) for r in kept]))
    kept = {r[0]: r for r in kept if component[r[0]] == r[0]}

    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    firsts = Counter(r.doc_id for r in found if r.piece == 0)
    assert set(firsts) <= set(kept)
    size = {d: len(WORD.findall(r[1])) for d, r in kept.items()}
    sizes = Counter()
    for d, r in kept.items():
        sizes[r[3]] += size[d]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = plain_targets(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    taken = Counter()
    for d, n in firsts.items():
        assert n <= 3
        taken[kept[d][3]] += n * size[d]
    assert all(abs(taken[s] - targets[s]) <= max(size.values()) for s in order)
    ids = dict(zip(kept, whole_ids([r[1] for r in kept.values()], 0)))
    assert_packed(found, [(d, ids[d]) for d, n in firsts.items() for _ in range(n)])


def test_line_dedup_leaves_copies_to_the_join(spark):
    rng = random.Random(4)
    line = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(8))
    body = [line() for _ in range(16)]
    rows = [(i, "\n".join(["menu", *body]), "en", "hot", 1) for i in range(60)]
    for i in range(100, 140):  # one line edited
        lines = list(body)
        lines[i % 16] = line()
        rows.append((i, "\n".join(["menu", *lines]), "en", "hot", 1))
    own = {i: [line() for _ in range(4)] for i in range(200, 400)}
    rows += [(i, "\n".join(["menu", *lines, "footer"] if i % 2 else lines), "en", "hot", 1) for i, lines in own.items()]
    rows += [(i, "menu\n footer", "en", "hot", 1) for i in range(500, 505)]  # nothing but boilerplate
    cut = linededup.stage_line_dedup(spark, frame(spark, rows), "")
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert len(texts) == len(rows) and {texts[i] for i in range(60)} == {"\n".join(body)}
    assert all(len(texts[i].split("\n")) == 16 for i in range(100, 140))
    assert all(texts[i] == "\n".join(lines) for i, lines in own.items())
    assert {texts[i] for i in range(500, 505)} == {""}
    left = corpus_pipeline.STAGES[2][1](spark, cut, "")
    assert {r.doc_id for r in left.collect()} - set(range(500, 505)) == {0, *own}
    packed = corpus_pipeline.STAGES[4][1](spark, corpus_pipeline.STAGES[3][1](spark, left, ""), "")
    assert {(r.doc_id, r.length) for r in packed.collect() if r.doc_id >= 500} == {(i, 1) for i in range(500, 505)}


def test_line_dedup_drops_what_few_sections_share(spark):
    rows, counts = [], {"small": (100, 5), "middle": (1000, 90), "hot": (3000, 70)}
    for k, (source, (n, planted)) in enumerate(counts.items()):
        for i in range(n):
            lines = [f"{source} own {i} {j}" for j in range(3)]
            lines[1:1] = ["section menu"] * (i < planted) + ["said by some"] * (n - i <= n // 100)
            rows.append((10_000 * k + i, "\n".join(lines), "en", source, 1))
    for r in linededup.stage_line_dedup(spark, frame(spark, rows), "").collect():
        n, i = counts[r.source][0], r.doc_id % 10_000
        assert r.text.split("\n") == [f"{r.source} own {i} 0", *["said by some"] * (n - i <= n // 100), *(f"{r.source} own {i} {j}" for j in (1, 2))]


def test_stages_keep_the_columns_and_odd_rows(spark, odd):  # noqa: F811
    docs, names = odd, odd.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == names, name
    assert {r.doc_id for r in docs.select("doc_id").collect()} <= {None, 4, 5, 6, 8, 9}
    nothing = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, "").count() == 0
