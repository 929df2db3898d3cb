"""The operators against brute force, exact round trips and held-out labels."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from check import canonical
from sparkevidence.llm import chat, classifier, decontam, html, langid, licenses, lm, packing, quality_rules, simhash
from sparkevidence.llm.queries import QUERIES, SQL

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return duckdb.connect().execute(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet' ORDER BY doc_id").fetchall()


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "conversations", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    got, want = QUERIES[name](spark, SMALL).toPandas(), db.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)


def test_repetition_against_word_lists(texts):
    some = [t for _, t in texts[:60]] + ["a b c a b c d", "x\nx \nx\n\n \n", "a b c d e f g h i j a b c d e f g h i j k"]
    got = quality_rules.repetition(some)
    for i, t in enumerate(some):
        ws = words_of(t)
        assert got["n_words"][i] == len(ws) and got["word_chars"][i] == sum(map(len, ws))
        for n in quality_rules.LENGTHS:
            grams = [tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)]
            times = Counter(grams)
            inside = {k + j for k, g in enumerate(grams) if times[g] > 1 for j in range(n)}
            assert got[f"dup_chars_{n}"][i] == sum(len(ws[k]) for k in inside)
            if n == 3:
                assert got["n_repeat_words"][i] == len(inside)
        lines = [x for x in t.split("\n") if words_of(x)]
        assert got["n_dup_lines"][i] == len(lines) - len(set(lines))


def test_packing_round_trip(spark, texts):
    rows = packing.pack(spark.read.parquet(f"{SMALL}/documents.parquet"), VOCABULARY).collect()
    tokenizer, got = Tokenizer.from_file(VOCABULARY), {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append(r)
    total = 0
    for doc, text in texts:
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        total += len(ids)
        own = sorted(got[doc], key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in own] == [(s, min(4096, len(ids) - s)) for s in range(0, len(ids), 4096)]
        assert [r["ids_crc32"] for r in own] == [zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in own]
    assert len({r["sequence_id"] for r in rows}) <= -(-total // 4096) + 1
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)


def test_tokenizer_word_by_word():
    odd = ["a\x1cb c\xa0d", "don't I'll  <|endoftext|>x", "é e ́", "İstanbul ΑΣ ΣΑΣ", "１２ ½ x²", "日本語 テキスト", "\x85 x", "x" * 3000, ""]
    tokenizer = Tokenizer.from_file(VOCABULARY)
    got = packing.WordTokenizer(VOCABULARY).ids(odd)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in odd]


def test_fullest_bin_against_all_subsets():
    rng = random.Random(1)
    for _ in range(60):
        left = {rng.randint(1, 40): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
        sums = {0}
        rest = [n for n, c in left.items() for _ in range(c - (n == max(left)))]
        for n in rest:
            sums |= {s + n for s in sums}
        chosen = packing.fullest(left, 50)
        assert all(m <= left[n] for n, m in chosen.items()) and chosen[max(left)] >= 1
        assert sum(n * m for n, m in chosen.items()) == max(left) + max(s for s in sums if s <= 50 - max(left))
    plan = packing.plan_bins({7: 10, 3: 11, 50: 2, 20: 5}, 50)
    used = Counter()
    for chosen, times in plan:
        assert sum(n * m for n, m in chosen.items()) <= 50
        for n, m in chosen.items():
            used[n] += m * times
    assert used == {7: 10, 3: 11, 50: 2, 20: 5}


def _fingerprint(text):
    ws = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    grams = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def _roots(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints_bit_by_bit(spark, texts):
    got = {r["doc_id"]: r["fingerprint"] for r in simhash.near_duplicates(spark.createDataFrame(texts[:80], "doc_id long, text string")).collect()}
    assert got == {d: f"{_fingerprint(t):016x}" for d, t in texts[:80]}


@pytest.mark.parametrize("paired", [1, 32, 10_000])
def test_links_against_all_pairs(spark, paired):
    """A hot group, chains and random fingerprints; the ways of small and of large buckets agree."""
    rng = random.Random(2)
    center, known = rng.getrandbits(64), set()
    for _ in range(150):
        known.add(center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(4):
            known.add(x)
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
    known = sorted(x - (1 << 64) if x >> 63 else x for x in known)
    pairs = [(a, b) for i, a in enumerate(known) for b in known[i + 1 :] if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2]
    links = simhash.links(spark.createDataFrame([(x,) for x in known], "fp long"), paired=paired)
    found = {(r["a"], r["b"]) for r in links.collect()}
    assert found <= set(pairs) and _roots(known, found) == _roots(known, pairs)
    roots = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    assert all(roots.get(n, n) == root for n, root in _roots(known, pairs).items())


def test_near_copies_by_similarity(spark):
    rng = random.Random(3)
    rows, n = [], 0
    for _ in range(20):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(300)]
        rows.append((n, " ".join(words)))
        for _ in range(3):
            copy = list(words)
            for at in rng.sample(range(300), 4):
                copy[at] = "changed"
            n += 1
            rows.append((n, " ".join(copy)))
        n += 1
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(0, 80, 4))


def _shingles(text):
    ws = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} or ({tuple(ws)} if ws else set())


def _near(a, b):
    return 5 * len(a & b) >= 4 * len(a | b) > 0


def test_near_copies_are_decided_by_exact_shingles(spark):
    """Pairs closely around 0.8: what an estimate would join below it, and what it would miss at it."""
    rng, rows = random.Random(6), []
    for n in range(60):
        words = [f"p{n}w{i}" for i in range(304)]
        copy = list(words)
        # Changed words far from each other cost five shingles each: 6 of 300 give 270/330, 7 give 265/335.
        for at in range(20, 20 + 40 * (6 + n % 2), 40):
            copy[at] = f"c{rng.random()}"
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(copy))]
    sets = dict((d, _shingles(t)) for d, t in rows)
    want = {d for d, _ in rows if d % 2 == 0 or not _near(sets[d - 1], sets[d])}
    assert len(want) == 90
    assert {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_near_copies_of_the_given_table(spark, texts):
    """Fingerprints within two bits or exact shingle sets alike at 0.8, over all pairs."""
    fps, sets = [_fingerprint(t) for _, t in texts], [_shingles(t) for _, t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2 or _near(sets[i], sets[j])]
    roots = _roots(range(len(texts)), near)
    kept = {r["doc_id"] for r in simhash.keep_one(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()}
    assert kept == {d for i, (d, _) in enumerate(texts) if roots[i] == i}


@pytest.mark.parametrize("block", [1, 128])
def test_every_near_copy_meets(spark, monkeypatch, block):
    """Texts that share a long passage with a smaller id but are no copies of it, and chains of copies: no pair is lost."""
    monkeypatch.setattr(simhash.open_pairs, "__defaults__", (block,))
    monkeypatch.setattr(simhash.common_shingles, "__defaults__", ("text", 1.0, 3, 50))
    rng, shared, rows = random.Random(7), [f"s{i}" for i in range(150)], []
    for n in range(12):
        own = [f"o{n}w{i}" for i in range(65)]
        for _ in range(4):
            rows.append(" ".join([*shared, *own]))
            own[rng.randrange(10, 60)] = f"x{rng.random()}"
            own = own[rng.randrange(2) :]
    rows = list(enumerate(rows))
    rng.shuffle(rows)
    fps, sets = {d: _fingerprint(t) for d, t in rows}, {d: _shingles(t) for d, t in rows}
    near = [(i, j) for i in sets for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2 or _near(sets[i], sets[j])]
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {d for d, root in _roots(sorted(sets), near).items() if d == root}
    common = simhash.common_shingles(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(common[0]) == 50
    groups = [(n, simhash.prefix(simhash.shingles(t), common).tolist(), len(sets[n])) for n, t in rows]
    met = simhash.meetings(spark.createDataFrame(groups, "id long, prefix array<long>, size int"))
    none = spark.createDataFrame([], "node long, root long")
    found = {(r["a"], r["b"]) for r in simhash.open_pairs(met, none).collect()}
    assert {(a, b) for a in sets for b in sets if a > b and sets[a] != sets[b] and _near(sets[a], sets[b])} <= found


def test_retrieval_above_the_threshold_is_complete():
    """Every passage against every entry, without bounds; parts of items stand in noise of the same words."""
    rng = random.Random(4)
    pool = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(pool, k=rng.randint(3, 150))) + ("? " + " ".join(rng.choices(pool, k=3)) if i % 2 else "")) for i in range(70)]
    df = Counter(t for _, text in items for t in set(decontam.tokens(text)))
    index = decontam.Index(items, df, len(items))
    texts = []
    for _ in range(40):
        words = rng.choices(pool, k=rng.randint(0, 500))
        for _ in range(rng.randint(0, 3)):
            own = items[rng.randrange(70)][1].split()
            at, cut = rng.randint(0, len(words)), rng.randint(len(own) // 2, len(own))
            words[at:at] = own[:cut]
        texts.append(" ".join(words))
    want = set()
    for t, text in enumerate(texts):
        ws = decontam.tokens(text)
        for start in range(-decontam.ENTRY, len(ws), decontam.ENTRY):
            inside = set(ws[max(0, start) : start + 2 * decontam.ENTRY])
            for e, impact in enumerate(index.impact):
                if sum(v for w, v in impact.items() if w in inside) >= index.threshold:
                    item = index.items[index.owner[e]]
                    size = len(item.words)
                    around = ws[max(0, start - size) : start + 2 * decontam.ENTRY + size]
                    if index.verified(item, decontam.overlap(item.question, around), decontam.overlap(item.answer, around), around):
                        want.add((t, index.owner[e]))
    assert {(t, n) for t, n, *_ in index.search(texts)} == want and len(want) > 20


def test_leaks_are_the_items_that_stand_in_texts(spark, texts):
    items = duckdb.connect().execute(f"SELECT item_id, text FROM '{SMALL}/benchmark.parquet'").fetchall()
    flat = lambda t: b" " + b" ".join(decontam.tokens(t)) + b" "
    want = {(d, i) for i, item in items for d, t in texts if flat(item) in flat(t)}
    assert {(r["doc_id"], r["item_id"]) for r in QUERIES["op5_decontamination"](spark, SMALL).collect()} == want


def test_items_in_blocks_give_the_same_leaks(spark, monkeypatch):
    one = {tuple(r)[:3] for r in QUERIES["op5_decontamination"](spark, SMALL).collect()}
    monkeypatch.setattr(decontam, "INDEX_BYTES", 1000)
    many = {tuple(r)[:3] for r in QUERIES["op5_decontamination"](spark, SMALL).collect()}
    assert {x[:2] for x in one} == {x[:2] for x in many}


def test_held_out_quality(spark):
    rows = classifier.classify(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    known = dict(duckdb.connect().execute("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet'").fetchall())
    held = [(r["score"], known[r["doc_id"]]) for r in rows.collect() if r["held_out"] and r["doc_id"] in known]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.97 and np.mean([(s >= 0.5) == y for s, y in held]) > 0.95


def test_discriminant_against_densities():
    rng = np.random.default_rng(5)
    x = [rng.normal(0, 1, (400, 3)), rng.normal(1, [1, 2, 0.5], (300, 3))]
    ones = [np.column_stack([np.ones(len(v)), v]) for v in x]
    model = classifier.fit(np.array([v.T @ v for v in ones]), 0.0, 0.0)
    at = rng.normal(0, 2, (50, 3))
    logs = []
    for v in x:
        c = np.cov(v.T, bias=True)
        weight = 3 / (len(v) + 3)
        pooled = sum(np.cov(u.T, bias=True) * len(u) for u in x) / 700 + 1e-4 * np.eye(3)
        c = (1 - weight) * c + weight * pooled
        gap = at - v.mean(axis=0)
        logs.append(math.log(len(v)) - 0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(c), gap) - 0.5 * np.linalg.slogdet(c)[1])
    assert np.allclose(model.score(at), 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -30, 30))))


@pytest.mark.parametrize("order", [2, 3])
def test_language_model_token_by_token(spark, texts, order):
    some = [*texts[:60], (1000, ""), (1001, None)]
    docs = spark.createDataFrame(some, "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm.score(docs, order=order, mu=50.0, block_tokens=700, range_entries=900).collect()}
    tokens = {d: [w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words_of(t or "")] + ["</s>"] for d, t in some}
    learned = [d for d in tokens if zlib.crc32(str(d).encode()) % 7 != 2]
    one = Counter(w for d in learned for w in tokens[d])
    two = Counter(g for d in learned for g in zip(["<s>", *tokens[d]], tokens[d]))
    three = Counter(g for d in learned for g in zip(["<s>", *tokens[d]], tokens[d], tokens[d][1:]))
    total, mass = sum(one.values()), sum(one.values()) + len(one) + 1
    for d, own in tokens.items():
        base = score = 0.0
        for i, w in enumerate(own):
            p = (one[w] + 1) / mass
            base += math.log10(p)
            before = own[i - 1] if i else "<s>"
            p = (two[before, w] + 50 * p) / ((one[before] if i else len(learned)) + 50)
            if order == 3 and i:
                first = own[i - 2] if i > 1 else "<s>"
                p = (three[first, before, w] + 50 * p) / (two[first, before] + 50)
            score += math.log10(p)
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (d not in learned, len(own), sum(one[w] > 0 for w in own), total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-9)


PAGE = """<html lang=en><body class="home"><header><h1>Site</h1></header><div id=wrap><div class="sidebar"><p>Side text, with a lot of words, more.</p></div>
<div class="content post-{n}"><h2>Head &amp; tail</h2><p>One <i>two</i>&nbsp;three<p>Four &lt;b&gt; 1 < 2 <a href="x">link</a><ul><li>a<li>b</ul>
<div class="comments"><p>Nice article, really good one!</p></div><form><input><label>Mail</label></form><p>{last}</p></div>
<div class="extra">{extra}</div><div class="cookie-notice">We use cookies, of course</div></div><footer>foot</footer><script>if(a<b){{"</p>"}}</script></body></html>"""


def test_host_consensus(spark):
    """One page's extra box outweighs its article; the host's other pages outvote it."""
    rows = [(n, f"https://h.example/{n}", PAGE.format(n=n, last="The story goes on. " * 9, extra="Short.")) for n in range(8)]
    rows.append((8, "https://h.example/8", PAGE.format(n=8, last="Brief.", extra="<p>" + "Offer of the day, cheap. " * 20 + "</p>")))
    rows.append((9, "https://other.example/", "<p>Only this, nothing else.</p>"))
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    head = "Head & tail\n\nOne two three\n\nFour <b> 1 < 2 link\n\na\n\nb\n\n"
    assert got[0] == head + ("The story goes on. " * 9).strip() and got[8] == head + "Brief." and got[9] == "Only this, nothing else."


LONG_STORY = ("The story goes on and on for quite some words here. " * 5).strip()


@pytest.mark.parametrize("page,text", [
    ('<nav><a href=x>Home</a></nav><div class="content has-sidebar"><h1>T</h1><p>{}</p></div><div class="sidebar">Buy now</div>', "T\n\n{}"),
    ('<article class="post tags-news"><h1>T</h1><p>{}</p></article>', "T\n\n{}"), ('<main id="legal"><p>{}</p></main>', "{}"),
    ("<form id=f><div class=content><p>{}</p></div></form><form>Search</form>", "{}"),
    ('<article><div class="post-header"><h1>Head</h1></div><p>{}</p><div class="comments"><p>Nice</p></div></article>', "Head\n\n{}"),
    ('<div class=content><h1>Head</h1><p>Lead is here.</p><div class=section><p>{}</p></div><div class=section><p>Second part.</p></div></div>', "Head\n\nLead is here.\n\n{}\n\nSecond part."),
    ('<div class=article><p>Short one here.</p></div><div class="comments"><p>{}</p></div>', "Short one here."),
])
def test_class_words_do_not_take_the_article(page, text):
    assert html.Page(page.format(LONG_STORY)).text(None) == text.format(LONG_STORY)


def test_pages_of_the_given_tables(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    raw = {r["page_id"]: r["html"] for r in pages.collect()}
    from html import unescape

    for r in html.extract(pages).collect():
        inside = re.search(r"<article>(.*?)(?:</article>|$)", raw[r["page_id"]], re.S)[1]
        parts = [" ".join(unescape(re.sub(r"</?b>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        assert r["text"] == "\n\n".join(filter(None, parts)) and r["n_chars"] == len(r["text"])


def test_languages_of_documents_and_pages(spark):
    docs, pages = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "pages"))
    taught = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    known = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = langid.identify(taught, pages).collect()
    held = [r["lang"] == known[r["doc_id"]] for r in rows if r["doc_id"] is not None and r["doc_id"] % 2]
    assert np.mean(held) > 0.95 and np.mean([r["lang"] == r["declared"] for r in rows if r["page_id"] is not None]) > 0.95


def test_evidence_speaks_where_the_text_is_silent(spark):
    docs = spark.createDataFrame([(0, "the cat and the dog sat there " * 9, "en", "s"), (1, "der hund und die katze sitzen hier " * 9, "de", "s")], "doc_id long, text string, lang string, source string")
    page = lambda n, host, lang, text: (n, f"http://{host}/", f'<html lang="{lang}"><p>{text}</p></html>')
    rows = [page(n, "a.example", "en", "the dog and the cat there") for n in range(20)] + [page(n, "b.example", "de", "die katze und der hund hier") for n in range(20, 40)]
    rows += [page(40, "b.example", "de", ""), page(41, "a.example", "de", "der hund und die katze sitzen hier")]
    got = {r["page_id"]: r for r in langid.identify(docs, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[40]["lang"] == "de" and got[40]["text_lang"] is None and got[41]["lang"] == "de"


def test_notices_in_place(spark):
    rows = [
        (0, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
        (1, "x y Licensed under CC BY-NC 4.0."), (2, "permission charge hereby free of granted"), (3, "GNU General Public License, MIT license; mit license"),
        (4, "redistribution and use in source and binary forms, with or without modification, are allowed provided that the following conditions are met")]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k]["labels"] for k in range(5)] == ["mit", "cc-by-nc", "", "gpl,mit", "bsd"]
    assert (got[3]["n_base"], got[3]["first_word"], got[3]["last_word"], got[3]["base_labels"]) == (3, 1, 6, "gpl,mit")


def test_snapshots_collapse(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "bot", f"turn {t}") for c, n in ((1, 2), (2, 4), (3, 4), (4, 3)) for t in range(n)]
    rows += [(5, 0, "user", "turn 0"), (5, 1, "bot", "other")]
    got = {r["conv_id"]: (r["n_turns"], r["n_copies"]) for r in chat.render(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    assert got == {2: (4, 2), 5: (2, 1)}


def test_cutting_the_index_changes_no_score(spark, monkeypatch):
    """Also with ids of another type, and both ids of one name."""
    rng = random.Random(5)
    items = [(f"i{n}", " ".join(f"w{rng.randrange(300)}" for _ in range(rng.choice((9, 30, 150))))) for n in range(30)]
    docs = spark.createDataFrame([(n, f"before {t} after") for n, (_, t) in enumerate(items)], "item_id long, text string")
    given = spark.createDataFrame(items, "item_id string, text string")
    whole = sorted(map(tuple, decontam.leaks(docs, given, key="item_id").collect()))
    monkeypatch.setattr(decontam, "INDEX_BYTES", 900)
    assert decontam.leaks(docs, given, key="item_id").columns[:2] == ["item_id", "benchmark_item_id"]
    assert sorted(map(tuple, decontam.leaks(docs, given, key="item_id").collect())) == whole and {r[1] for r in whole} == {i for i, _ in items}


def test_pipeline_against_brute_force(spark, texts):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    stats = quality_rules.repetition([t for _, t in texts])
    kept = [x for x, k in zip(texts, quality_rules.judge(stats)[1]) if k]
    labels = dict(duckdb.connect().execute(f"SELECT doc_id, quality FROM '{SMALL}/labels.parquet'").fetchall())
    taught = [(d, t) for d, t in texts if d in labels and zlib.crc32(str(d).encode()) % 3 != 1]
    x = np.column_stack([np.ones(len(taught)), classifier.statistics([t for _, t in taught])])
    y = np.array([labels[d] for d, _ in taught])
    model = classifier.fit(np.array([x[y == k].T @ x[y == k] for k in (0, 1)]))
    kept = [x for x, s in zip(kept, model.score(classifier.statistics([t for _, t in kept]))) if s >= 0.5]
    fps, sets = [_fingerprint(t) for _, t in kept], [_shingles(t) for _, t in kept]
    near = [
        (i, j) for i in range(len(kept)) for j in range(i)
        if bin(fps[i] ^ fps[j]).count("1") <= 2 or _near(sets[i], sets[j])]
    roots = _roots(range(len(kept)), near)
    kept = [x for i, x in enumerate(kept) if roots[i] == i]
    items = duckdb.connect().execute(f"SELECT text FROM '{SMALL}/benchmark.parquet'").fetchall()
    flat = lambda t: b" " + b" ".join(decontam.tokens(t)) + b" "
    kept = [(d, t) for d, t in kept if not any(flat(i) in flat(t) for (i,) in items)]
    assert {r["doc_id"] for r in rows} == {d for d, _ in kept}
    tokenizer = Tokenizer.from_file(VOCABULARY)
    total = sum(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for _, t in kept)
    assert sum(r["length"] for r in rows) == total and len({r["sequence_id"] for r in rows}) <= -(-total // 4096) + 1


def test_rows_left_apart_meet_shares_of_a_large_group(spark):
    """10 rows beside a connected group of 400: each meets about DEALT of them, not all, and one link joins a row to the group."""
    met = spark.range(410).select(F.lit(7).cast("long").alias("value"), F.struct("id", F.lit(100).alias("size"), F.lit(0).alias("at")).alias("own"))
    roots = spark.range(1, 400).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("root"))
    rooted = simhash._rooted(met, roots)
    pairs = [(r["a"], r["b"]) for r in simhash.stars_between(rooted, 0, centres=1).collect()]
    assert all(a >= 400 > b for a, b in pairs) and {a for a, _ in pairs} == set(range(400, 410))
    assert len(pairs) < 10 * 3 * simhash.DEALT < 10 * 400
    assert not simhash.crowded(rooted, centres=10) and simhash.crowded(rooted, centres=9)
    after = simhash.joined(roots, spark.createDataFrame([(405, 17), (409, 405)], "a long, b long"))
    assert {r["node"]: r["root"] for r in after.collect()} == {n: 0 for n in [*range(1, 400), 405, 409]}
    assert simhash.open_pairs(met, after).filter("a in (405, 409) and b < 400").count() == 0
    assert simhash.open_pairs(met, after).filter("a = 400").count() == 400
