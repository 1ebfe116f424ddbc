"""The training-data operators against brute force."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexmill.llm import bpe, extract, fingerprint, graph, langid, lm, media, neardup, packing, queries, resample, sharding, shingles, simhash, suffix
from lexmill.llm.common import crc32_of_id

LAST = (1 << 63) - 1
TOKENIZER = Tokenizer.from_file(queries.BPE)


def same_rows(df, rows):
    """A result has the input's ids, as often."""
    assert Counter(r["doc_id"] for r in df) == Counter(r[0] for r in rows)


# 1: sharding


def test_sharding(docs, rows, nothing):
    got = sharding.interleave(docs, 4).collect()
    same_rows(got, rows)
    by = defaultdict(list)
    mix = defaultdict(Counter)
    for r in got:
        by[r["shard"]].append(r["slot"])
        mix[r["source"]][r["shard"]] += 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(4))
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    for source, counts in mix.items():
        whole = sum(counts.values()) / 4
        assert all(abs(counts[s] - whole) <= 2 for s in range(4)), (source, counts)
    crc = Counter((r[0], zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()) + 16) for r in rows)
    assert Counter((r["doc_id"], r["text_crc32"], r["size"]) for r in got) == crc
    assert sharding.interleave(nothing, 4).count() == 0
    again = sharding.interleave(docs.repartition(5), 4).select("doc_id", "text_crc32", "shard", "slot")
    assert Counter(map(tuple, again.collect())) == Counter((r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in got)
    plan = sharding.interleave(docs, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 2: near duplicates


def bag(text, width=5):
    words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())
    if not words:
        return Counter()
    return Counter([tuple(words[i : i + width]) for i in range(len(words) - width + 1)] or [tuple(words)])


def test_near_duplicates(spark):
    rng = random.Random(1)
    vocab = [f"w{k}" for k in range(3000)]
    bases = [[rng.choice(vocab) for _ in range(rng.randint(3, 200))] for _ in range(60)]
    texts = [" ".join(b) for b in bases]
    for b in bases[:30]:
        for edits in (1, 2, 4, 8, 16):
            c = list(b)
            for _ in range(edits):
                c[rng.randrange(len(c))] = rng.choice(vocab)
            texts.append(" ".join(c))
    texts += [texts[0], texts[0], "", None, "?!", "?!"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in neardup.classes(df.repartition(4)).collect()}
    frequencies = neardup.document_frequencies(df)
    idf = neardup.idf_weights(frequencies, len(texts))
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    bags = [neardup.weighted_bag(t or "", idf) for t in texts]
    for i, j in itertools.combinations(range(len(texts)), 2):
        if (texts[i] or "") == (texts[j] or "") or neardup.weighted_jaccard(bags[i], bags[j]) >= 0.8:
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    assert {i: r["class_id"] for i, r in got.items()} == {i: root(i) for i in range(len(texts))}
    kept = neardup.keep_one(df).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({root(i) for i in range(len(texts))})


@pytest.mark.parametrize("together", [0, 512])
def test_near_duplicates_by_either_way(spark, monkeypatch, together):
    """A family of texts around the threshold: classes are those of all pairs, whether one task compares them or lists do."""
    monkeypatch.setattr(neardup, "TOGETHER_TEXTS", together)
    rng = random.Random(4)
    vocab = [f"w{k}" for k in range(3000)]
    base = [rng.choice(vocab) for _ in range(150)]
    texts = []
    for _ in range(70):
        c = list(base)
        for _ in range(rng.randint(0, 9)):
            c[rng.randrange(len(c))] = rng.choice(vocab)
        texts.append(" ".join(c))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    idf = neardup.idf_weights(neardup.document_frequencies(df), len(texts))
    bags = [neardup.weighted_bag(t, idf) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if neardup.weighted_jaccard(bags[i], bags[j]) >= 0.8:
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    assert 2 < len({root(i) for i in range(len(texts))}) < len(texts)
    assert {r["doc_id"]: r["class_id"] for r in neardup.classes(df).collect()} == {i: root(i) for i in range(len(texts))}
    links = neardup.near_within(texts, idf, 0.8)
    assert len(links) == len(texts) - len({root(i) for i in range(len(texts))}) and all(root(i) == root(j) for i, j in links)


def test_near_duplicates_look_up_classes_once_a_text(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TOGETHER_TEXTS", 0)
    asked, real = [], neardup._classed
    monkeypatch.setattr(neardup, "_classed", lambda members, labels: asked.append(members.count()) or real(members, labels))
    rng = random.Random(4)
    vocab = [f"w{k}" for k in range(3000)]
    base = [rng.choice(vocab) for _ in range(150)]
    texts = [" ".join(rng.choice(vocab) if rng.random() < 0.03 else w for w in base) for _ in range(70)]
    neardup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert asked and asked[0] <= len(texts)


def test_near_duplicates_of_awkward_rows(docs, rows, nothing):
    got = neardup.classes(docs).collect()
    same_rows(got, rows)
    assert neardup.classes(nothing).count() == 0 and neardup.keep_one(nothing).columns == nothing.columns
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    # Two texts have the id 3, each a class of its own.
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(dict({bytes(r["class_key"]): r["class_id"] for r in got}).values())


def test_near_duplicates_keep_every_class(spark, docs):
    say = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    more = [(None, say("a", 30)), (None, say("a", 30)), (None, say("a", 29)), (None, say("b", 30)), (3, say("c", 30)), (3, say("c", 30)), (4, say("c", 29))]
    every = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string")).cache()
    class_of = {bytes(r["key"]): bytes(r["class_key"]) for r in neardup.classes(every).collect()}
    key = lambda t: hashlib.sha256((t or "").encode()).digest()[:16]
    assert class_of[key(say("a", 30))] == class_of[key(say("a", 29))] != class_of[key(say("b", 30))]
    kept = neardup.keep_one(every).collect()
    assert Counter(class_of[key(r["text"])] for r in kept) == Counter(set(class_of.values()))
    assert Counter(r["doc_id"] for r in kept)[3] == 3 and Counter(r["doc_id"] for r in kept)[None] == 2


def test_samples_follow_weighted_jaccard():
    rng = np.random.default_rng(0)
    close = []
    for _ in range(40):
        n = 300
        names = shingles.numbers(2 * n, int(rng.integers(1 << 30)))
        wa, wb = rng.choice([0.75, 0.9, 1.0, 2.0, 3.0], n), rng.choice([0.75, 0.9, 1.0, 2.0, 3.0], n)
        a, b = (names[:n], wa), (np.concatenate([names[: n - 60], names[n : n + 60]]), np.concatenate([wa[: n - 60], wb[:60]]))
        drawn = [neardup.samples(x >> np.uint64(16), w.astype(np.float32), np.array([0])) for x, w in (a, b)]
        order = lambda x: (np.sort(x[0]), x[1][np.argsort(x[0])])
        close.append((drawn[0] == drawn[1]).mean() - neardup.weighted_jaccard(order(a), order(b)))
    assert abs(np.mean(close)) < 0.03


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 140)] + [(200, k) for k in range(201, 240)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    assert got == {x: root(x) for x in parent}


@pytest.mark.parametrize("few", [0, 100_000])
def test_components_of_few_and_many_links(spark, monkeypatch, few):
    """The same classes either way; few links take no exchange once they are told apart."""
    monkeypatch.setattr(graph, "FEW_LINKS", few)
    rng = random.Random(13)
    name = lambda k: bytes([200 - k, k])
    links = [(name(rng.randint(0, 60)), name(rng.randint(0, 60))) for _ in range(45)]
    want = {x: {x} for pair in links for x in pair if pair[0] != pair[1]}
    for a, b in links:
        if a != b:
            both = want[a] | want[b]
            for x in both:
                want[x] = both
    got = graph.components(spark.createDataFrame(links, "a binary, b binary"))
    assert {bytes(r["node"]): bytes(r["root"]) for r in got.collect()} == {x: min(c) for x, c in want.items()}
    assert few == 0 or "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 3: language


def test_language(spark, nothing, docs, rows):
    rng = random.Random(4)
    syllables = {"p": ["ka", "mo", "ri", "tesu"], "q": ["bern", "schlo", "unt", "acht"], "r": ["oux", "elle", "ien", "que"]}
    say = lambda k, n: " ".join("".join(rng.choice(syllables[k]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    data = [(i, say(k, rng.randint(4, 300)), k) for i, k in enumerate(rng.choices("pqr", k=400))]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = langid.learn(df.filter("doc_id < 200"))
    got = langid.classify(df.filter("doc_id >= 200"), model).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    odd = langid.classify(docs.select("doc_id", "text"), model).collect()
    same_rows(odd, rows)
    assert all((r["lang_pred"] == "und") == (not r["text"] or not any(c.isalpha() for c in r["text"])) for r in odd)
    assert langid.learn(nothing) == {} and langid.classify(nothing, {}).count() == 0
    assert {r["lang_pred"] for r in langid.classify(df.limit(5), {}).collect()} == {"und"}
    assert langid.keep_identified(docs).columns == docs.columns


# 4: packing


def test_packing(docs, rows, nothing):
    got = packing.pack_documents(docs, queries.BPE, size=64, open_bins=8).collect()
    want = Counter()
    for r in rows:
        ids = TOKENIZER.encode(r[1] or "", add_special_tokens=False).ids + [2]
        s, k, e = 0, 0, len(ids) % 64 or 64
        while s < len(ids):
            want[r[0], k, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes())] += 1
            s, e, k = e, e + 64, k + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) <= 1.1 * sum(r["length"] for r in got) / 64 + 8
    assert packing.pack_documents(nothing, queries.BPE).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=80), st.integers(1, 6))
def test_best_fit(lengths, most):
    bins, used, open_ = packing.BestFit(32, most), {}, {}
    for n in lengths:
        fits = [32 - u for u in open_.values() if u + n <= 32]
        at, offset = bins.put(n)
        if fits:
            assert 32 - open_[at] == min(fits)  # the tightest
        else:
            assert at not in used
            alive = {k for held in bins.by_free for k in held}
            closed = set(open_) - alive
            assert len(closed) == (len(open_) >= most) and all(open_[k] == max(open_.values()) for k in closed)
            open_ = {k: v for k, v in open_.items() if k not in closed}
        assert offset == used.get(at, 0)
        used[at] = open_[at] = offset + n
        if used[at] == 32:
            open_.pop(at)
        assert len(open_) == bins.n_open <= most


# 5: extraction


def test_extraction(spark):
    para = "A paragraph of the article with quite a few words in it, to be kept."
    page = f"""<html><head><title>T</title><style>x</style></head><body><header>Site</header><nav><ul><li><a href=1>Menu</a></li></ul></nav><div class="cookie-notice">We use cookies on this site, please do agree with it.</div>
    <article><header><h1>Title &amp; more</h1></header><p>{para}</p><p>One.</p><aside>Related things to read here and there</aside><p>a&nbsp;<b>b</b>
    c<br>d<p>last &lt;p&gt;<script>var s="</p>";</script><form><input>Search the whole site for anything</form></article><section id="comments"><p>{para}</p></section><footer>&copy; all rights reserved by somebody</footer></body></html>"""
    want = f"Title & more\n{para}\nOne.\na b c d\nlast <p>"
    plain = f"<div class=menu><a>x</a></div><div><p>{para}</p><p>Short</p><p>{para}</p></div><div class='footer'>{para}</div>"
    df = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, None, ""), (1, "u", page), (4, "u", plain), (5, "u", "<nav>only menus here</nav>")], "page_id long, url string, html string")
    got = Counter((r["page_id"], r["text"], r["n_chars"]) for r in extract.extract(df).collect())
    texts = [(1, want), (1, want), (2, ""), (3, ""), (4, f"{para}\nShort\n{para}"), (5, "")]
    assert got == Counter((i, t, len(t)) for i, t in texts)
    assert extract.extract(df.limit(0)).count() == 0


def test_extraction_of_the_pages(spark, data):
    for r in extract.extract(spark.read.parquet(f"{data}/pages.parquet")).collect():
        assert r["text"] and r["n_chars"] == len(r["text"]) and "track(" not in r["text"]


PARA = "A paragraph of the page with quite a few words in it, which must be kept."


@pytest.mark.parametrize("around", ["<article>%s</article>", "<div>%s</div>"])
@pytest.mark.parametrize("between", ["<aside><h3>Related</h3><ul><li>One</li><li>Two</li><li>Three</li></ul></aside>", "<nav><div>a</div><div>b</div><div>c</div><div>d</div></nav>", "<div class=advert><div>Buy</div><div>this</div><div>thing</div><div>now</div></div>"])
def test_extraction_goes_on_behind_marked_blocks(around, between):
    page = around % (f"<p>{PARA} 1</p>" + between + f"<p>{PARA} 2</p><p>{PARA} 3</p>" + between + f"<p>{PARA} 4</p>")
    assert extract.main_text(page) == "\n".join(f"{PARA} {k}" for k in (1, 2, 3, 4))


@pytest.mark.parametrize("head", ["<head><title>t</title><style>p{}</style><body>", "<head><meta charset=utf-8><title>t</title><script>x()</script>", "<HEAD><TITLE>t</TITLE></HEAD><BODY>", "<title>t</title>", "<head class=banner><link rel=x>"])
def test_extraction_without_the_end_of_the_head(head):
    assert extract.main_text(f"<html>{head}<article><p>{PARA}</p></article>") == PARA


LONG = "".join(f"<p>{PARA} {k}</p>" for k in range(4))
LONG_TEXT = "\n".join(f"{PARA} {k}" for k in range(4))


@pytest.mark.parametrize(
    "page",
    [
        f"<div>{LONG}</div><aside><article><p>{PARA} teaser</p></article></aside>",
        f"<div>{LONG}</div><article class='comment'><p>{PARA} comment</p></article>",
        f"<article>{LONG}</article><article class='comment'>{LONG}{LONG}</article>",
        f"<article>{LONG}</article><section id='comments'><article>{LONG}{LONG}</article></section>",
        f"<div>{LONG}</div><div><a href=1>a</a></div>" + "<div><a href=1>more</a></div>" * 5 + f"<article><p>{PARA} teaser</p></article>",
        f"<article><p>{PARA} 0</p><p>{PARA} 1</p></article><article><p>{PARA} 2</p><p>{PARA} 3</p></article>",
        f"<aside><p>Not closed<article>{LONG}</article>",
        f"<div class=advert><article class='post tag-social category-newsletter'>{LONG}</article>",
        f"<form><main>{LONG}</main></form>",
    ],
)
def test_extraction_weighs_containers(page):
    assert extract.main_text(page) == LONG_TEXT


@pytest.mark.parametrize(
    "page",
    [
        "".join(f"<p>{PARA} {k}</p>" for k in range(5)) + "<div class=advert>" + "<p>Buy now</p>" * 4 + "</div>" + "".join(f"<p>{PARA} {k}</p>" for k in range(5, 9)),
        "".join(f"<p>{PARA} {k}</p>" for k in range(5)) + "<p><a href=x>Buy now</a></p>" * 4 + "".join(f"<p>{PARA} {k}</p>" for k in range(5, 9)),
        "<article>" + "".join(f"<p>{PARA} {k}</p>" for k in range(4)) + "</article><article>" + "".join(f"<p>{PARA} {k}</p>" for k in range(4, 9)) + "</article>",
    ],
)
def test_extraction_keeps_all_runs(page):
    assert extract.main_text(page) == "\n".join(f"{PARA} {k}" for k in range(9))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 70), st.booleans()), max_size=25))
def test_extraction_against_line_blocks(blocks):
    """Window by window, as the method is defined, on pages without articles."""
    lines = [("x" * n, linked) for n, linked in blocks if n]
    weights = [0 if linked else len(t) for t, linked in lines]
    sums = [sum(weights[i : i + extract.WINDOW]) for i in range(len(weights))]
    kept, on = [], False
    for i, total in enumerate(sums):
        on = total >= extract.SURGE or on and total > 0  # a surge begins a run, a dive ends it
        kept.append(on)
    out = []
    for i in range(len(lines)):
        if kept[i]:
            first = next(k for k in range(i, -1, -1) if k == 0 or not kept[k - 1])
            last = next(k for k in range(i, len(lines)) if k == len(lines) - 1 or not kept[k + 1])
            out += [lines[i][0]] * (any(weights[first : i + 1]) and any(weights[i : last + 1]))
    page = "".join(f"<div><a href=1>{t}</a></div>" if linked else f"<div>{t}</div>" for t, linked in lines)
    assert extract.main_text(page) == "\n".join(out if any(kept) else [t for t, _ in lines])


@pytest.mark.parametrize("piece", ["<a ", "<div>", "</span><div>", "<p class='x", '<a title="x', "<!--", "<script>", "<", "&amp", "<p>x", "<aside><article>", "<svg/>", " "])
def test_extraction_is_linear(piece):
    page = piece * (1_000_000 // len(piece))
    began = time.process_time()
    extract.main_text(page)
    assert time.process_time() - began < 20  # a quadratic scan takes hours


def test_extraction_of_clashing_columns(spark):
    df = spark.createDataFrame([(1, "u", f"<p>{PARA}</p>", "t", 5)], "page_id long, url string, html string, text string, n_chars int")
    assert [tuple(r) for r in extract.extract(df).collect()] == [(1, "u", PARA, len(PARA))]


# 6: language model


def test_language_model(docs, rows, nothing):
    held = (crc32_of_id(F.col("doc_id")) % 7) == 2
    got = lm.score_documents(docs, held).collect()
    same_rows(got, rows)
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    is_held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for r in rows if not is_held(r[0]) for w in words(r[1]))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for r in rows:
        w = words(r[1])
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)
        want[r[0], is_held(r[0]), len(w), sum(counts[x] > 0 for x in w), n, round(base, 4)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert lm.score_documents(nothing, held).count() == 0


def small_model(spark, texts, parts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
    dealt, n_buckets, n_weights = lm._dealt(df, F.lit(False))
    told = lm.token_counts(dealt.select("block", "held_out", "text"), n_buckets)
    return lm.learn(dealt, told, n_weights), df


def naive_score(model, counts, text):
    """Token by token and class by class, by the definition."""
    mask = (1 << 64) - 1
    mix = lambda x: int(shingles.mix(np.array([x & mask], np.uint64))[0])
    t = lm.tokens_of([text])
    names = {h & mask: k for k, h in enumerate(model.singles)}
    h, e = [int(x) for x in t.hashes], [int(x) for x in t.endings]
    total = 0.0
    for i, x in enumerate(h):
        back = lambda v, k: v[i - k] if i >= k else 7
        contexts = [mix(back(h, 1) + 1), mix(back(h, 2) + 2), mix(mix(back(e, 1) * 0x9E3779B97F4A7C15 + back(e, 2)) + 3)]
        leaf = names.get(x, lm.SINGLES + e[i] % lm.ENDINGS)
        node = 1
        for level in range(lm.LEVELS):
            branch = leaf >> (lm.LEVELS - 1 - level) & 1
            odds = float(model.bias[node])
            for c in contexts:
                name = ((c ^ (node * 0xD6E8FEB86659FD93 & mask)) * 0x9E3779B97F4A7C15) & mask
                odds += float(model.weights[name >> (65 - len(model.weights).bit_length())])
            total -= math.log10(1 + math.exp(-odds if branch else odds))
            node = 2 * node + branch
        if leaf >= lm.SINGLES:
            total += math.log10((counts[x] + 1) / model.room[leaf - lm.SINGLES])
    return total


def test_language_model_against_its_definition(spark, data):
    texts = [r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").limit(60).collect()] + ["", "a", "A a", "unseen-token here"]
    model, df = small_model(spark, texts, 3)
    counts = Counter(int(x) for t in texts for x in lm.tokens_of([t]).hashes)
    got = {r["doc_id"]: r["score"] for r in lm.score_documents(df, F.lit(False)).collect()}
    assert np.any(model.weights) and len(got) == len(texts)
    for i, t in enumerate(texts):
        if len(t) < 3000:
            assert math.isclose(got[i], naive_score(model, counts, t), rel_tol=1e-4, abs_tol=1e-4)


def test_language_model_is_a_distribution(spark, data):
    """All tokens of the vocabulary, and an unseen one in each shared leaf, add up to 1 in any context."""
    texts = [r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").limit(40).collect()]
    model, _ = small_model(spark, texts, 2)
    assert math.isclose(model.prior.sum(), model.n + lm.LEAVES)
    t = lm.tokens_of(texts[:1])
    for at in (0, 1, min(30, len(t.hashes) - 1)):
        leaves = np.arange(lm.LEAVES)
        contexts = np.repeat(t.contexts()[:, at : at + 1], lm.LEAVES, axis=1)
        _, odds, taken = model.steps(contexts, leaves)
        p = np.prod(1 / (1 + np.exp(np.where(taken, -odds, odds).astype(np.float64))), axis=0)
        assert math.isclose(p.sum(), 1, rel_tol=1e-6)
    # Within a shared leaf: the known tokens' (count + 1) and one unseen token's 1 make up the room.
    found = lm._concatenated(texts)
    names, first, n = np.unique(found.hashes, return_index=True, return_counts=True)
    shared = ~np.isin(names.view(np.int64), model.singles)
    room = 1 + np.bincount((found.endings[first] % np.uint64(lm.ENDINGS)).astype(int)[shared], n[shared] + 1, lm.ENDINGS)
    assert np.array_equal(room, model.room)


def test_language_model_does_not_depend_on_files(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet")
    held = (crc32_of_id(F.col("doc_id")) % 7) == 2
    scores = [{r["doc_id"]: r["score"] for r in lm.score_documents(x, held).collect()} for x in (d.coalesce(1), d.repartition(7, "text"))]
    assert scores[0] == scores[1]


def test_language_model_beats_its_base(spark, data):
    d = spark.read.parquet(f"{data.replace('0.001', '0.01')}/documents.parquet")
    r = lm.score_documents(d, (crc32_of_id(F.col("doc_id")) % 7) == 2).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1] + 0.05 * 57_634  # of so many tokens each is likelier by a factor of 1.12 at least


# 7: fingerprints


def test_fingerprints(docs, rows, nothing):
    got = fingerprint.compare_edits(docs).collect()
    same_rows(got, rows)
    ids = sorted({r[0] for r in rows if r[0] is not None}, reverse=True)
    after = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    texts = defaultdict(set)
    for r in rows:
        texts[r[0]].add(r[1] or "")

    def edited(i, t):
        k = len(t) // 3
        heads = {""} if i is None else {max(x[:k] for x in texts[after[i]])}
        return {hashlib.sha256((t[: len(t) - k] + h).encode()).hexdigest() for h in heads}

    allowed = defaultdict(set)
    prints = defaultdict(set)
    for r in rows:
        allowed[r[0]] |= edited(r[0], r[1] or "")
    for r in got:
        assert r["edited_sha256"] in allowed[r["doc_id"]]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    for r in got:
        if len(texts[r["doc_id"]]) == 1:
            prints[next(iter(texts[r["doc_id"]]))].add(r["fingerprint"])
    assert all(len(v) == 1 for v in prints.values())
    assert fingerprint.compare_edits(nothing).count() == 0


def test_fingerprints_are_homomorphic(spark):
    df = spark.createDataFrame([(1, "aaa\nbbb\nccc"), (2, "ccc\naaa\nbbb"), (3, "aaa\nbbb"), (4, "ccc"), (5, "aaa\nbbb\nccc\nccc"), (5, "aaa\nbbb\nccc\nccc")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(df, ["doc_id"]).collect()}
    assert got[1]["exact"] == got[2]["exact"] != got[5]["exact"]
    assert [(a + b) % (1 << 32) for a, b in zip(got[3]["exact"], got[4]["exact"], strict=True)] == got[1]["exact"]
    assert [a - b for a, b in zip(got[5]["signs"], got[4]["signs"], strict=True)] == got[1]["signs"] and got[5]["copies"] == 2


# 8: media


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=600), st.sampled_from([0, 1, 253, 254, 255, 4000, 65_000, 66_000]))
def test_media_round_trip(tail, n):
    data = bytes(i % 256 for i in range(n)) + tail
    streams = media.read(media.write(data, b"note"))
    found, s = media.payload_of(streams)
    assert found == data and streams[media.NOTE].packets[1] == b"note"
    assert not data or media.times(s)[-1] == len(data) / media.RATE


def test_media_checks(docs, rows, nothing):
    stored = media.write(bytes(1000))
    for k in (0, 30, len(stored) // 2, len(stored) - 1):
        with pytest.raises(media.BadStream):
            media.read(stored[:k] + bytes([stored[k] ^ 1]) + stored[k + 1 :])
    with pytest.raises(media.BadStream):
        media.read(stored[:-5])
    got = media.inspect_media(media.store_texts(docs)).collect()
    want = Counter()
    for r in rows:
        raw = (r[1] or "").encode()
        p = raw + bytes(-len(raw) % 64 or 64 * (not raw))
        want[r[0], len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    assert media.inspect_media(media.store_texts(nothing)).count() == 0


# 9: repeated passages


def removed(rows, length=50):
    least = {}
    data = [(LAST if r[0] is None else r[0], (r[1] or "").encode()) for r in rows]
    for i, d in data:
        for s in range(len(d) - length + 1):
            w = d[s : s + length]
            least[w] = min(i, least.get(w, i))
    for i, d in data:
        gone = np.zeros(len(d), bool)
        for s in range(len(d) - length + 1):
            if least[d[s : s + length]] < i:
                gone[s : s + length] = True
        yield i, d, gone


def as_counter(rows):
    return Counter((i, len(d), int(g.sum()), int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()), hashlib.sha256(np.frombuffer(d, np.uint8)[~g].tobytes()).hexdigest()) for i, d, g in removed(rows))


def measured(df):
    return Counter((LAST if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.measure_repeats(df).collect())


def test_repeats(docs, rows, nothing):
    assert measured(docs) == as_counter(rows)
    assert suffix.measure_repeats(nothing).count() == 0
    cut = suffix.remove_repeats(docs)
    assert cut.columns == docs.columns
    assert Counter((r["doc_id"], r["text"] is None) for r in cut.collect()) == Counter((r[0], r[1] is None) for r in rows)


def test_repeats_of_a_small_alphabet(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("ab\0 é") for _ in range(120)) for _ in range(5)]
    rows = [(rng.randint(0, 60), "".join(rng.choice([rng.choice(base)[rng.randint(0, 60) : rng.randint(60, 120)], "".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))]) for _ in range(rng.randint(0, 6)))) for _ in range(90)]
    rows += [(5, "ab" * 2000), (7, "ba" * 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert measured(df) == as_counter(rows)


def test_repeats_at_heavy_anchors(spark, monkeypatch):
    """A passage between other words each time, with every shared anchor heavy and all buckets and flushes small."""
    for name, value in (("HEAVY_LEAST", 2), ("HEAVY_SHARE", 0.0), ("ANCHORS_A_FLUSH", 60), ("ANCHORS_A_BUCKET", 40), ("SUFFIXES_A_FLUSH", 50), ("SUFFIXES_A_BUCKET", 30)):
        monkeypatch.setattr(suffix, name, value)
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(30)) for _ in range(3)]
    rows = [(i, " ".join([*(word() for _ in range(rng.randint(0, 12))), rng.choice(passages)[rng.randint(0, 20) :], *(word() for _ in range(rng.randint(0, 12)))])) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    shared = suffix.shared_anchors(df.selectExpr("unhex(substring(sha2(text, 256), 1, 32)) as th", "text"), 10_000)
    assert shared.filter("heavy is not null").count() > 0
    assert measured(df) == as_counter(rows)


def test_repeats_come_back_as_one_row_a_text(spark, monkeypatch):
    for name, value in (("SUFFIXES_A_FLUSH", 50), ("SUFFIXES_A_BUCKET", 30)):
        monkeypatch.setattr(suffix, name, value)
    rng = random.Random(9)
    passages = ["".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(3)]
    rows = [(i, f"{i} {passages[i % 3]} {rng.random()} {passages[(i + 1) % 3]}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    texts = df.selectExpr("unhex(substring(sha2(text, 256), 1, 32)) as th", "doc_id as id", "text").cache()
    found = [bytes(r["th"]) for r in suffix.repeated_strings(texts, suffix.shared_anchors(texts, 20_000).cache(), 1000).collect()]
    assert len(found) == len(set(found)) > 0
    assert measured(df) == as_counter(rows)


def test_anchors_of_many_texts_at_once(monkeypatch):
    """As of each text's pieces alone, however texts are put together; and what is sent on goes in small batches."""
    rng = random.Random(11)
    texts = ["".join(rng.choice("abc d") for _ in range(n)).encode() for n in (0, 49, 50, 51, 700, 50, 99, 100, 3000, 120, 10)]
    monkeypatch.setattr(suffix, "PIECE", 500)
    want = []
    for k, t in enumerate(texts):
        for base, piece in suffix.pieces_of(t):
            want += [(k, base + p, h, p - l, p - f) for p, h, f, l in zip(*map(np.ndarray.tolist, suffix.anchors(piece)), strict=True)]
    for most in (1, 600, 1 << 16):
        monkeypatch.setattr(suffix, "BLOCK", most)
        got = []
        for data, who, place, at, keys, first, last in suffix.anchors_of(texts):
            assert all(bytes(data[a : a + 24]) == texts[w][p : p + 24] for w, p, a in zip(who, place, at, strict=True))
            got += list(zip(who.tolist(), place.tolist(), keys.tolist(), (at - last).tolist(), (at - first).tolist(), strict=True))
        assert got == want
    batches = list(suffix._batches(((k, bytes(16), bytes(400_000), None) for k in range(20)), suffix._PART_ROWS.remove(4)))
    assert [r for b in batches for r in b.column(0).to_pylist()] == list(range(20)) and max(b.num_rows for b in batches) == 3


def test_one_name_for_two_strings():
    """Strings whose hashes agree are still told apart."""
    n = 6
    right = np.zeros((n, 50), np.uint8)
    right[:, :24] = 7
    left = np.zeros((n, 26), np.uint8)
    left[:, 0] = [1, 2, 1, 2, 3, 3]
    s = suffix.Suffixes(right, left, np.array([5, 5, 6, 4, 9, 9]), np.arange(n), np.arange(n), np.full(n, 2, np.uint32), np.zeros(n, np.uint64))
    true_mix = suffix.mix
    try:
        suffix.mix = lambda x: np.zeros_like(x)
        got = suffix.settle(s, suffix.common_prefixes(right))
    finally:
        suffix.mix = true_mix
    assert got.tolist() == [0, 2, 2, 0, 0, 0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text(alphabet="ab", min_size=6, max_size=6), max_size=12), min_size=1, max_size=7))
def test_loser_tree(runs):
    made = []
    for run in runs:
        strings = sorted(s.encode() for s in run)
        shared = [0] + [next((k for k in range(6) if x[k] != y[k]), 6) for x, y in zip(strings, strings[1:])]
        made.append((strings, shared[: len(strings)]))
    run, place, prefix = suffix.LoserTree(made).merge()
    got = [made[r][0][p] for r, p in zip(run, place, strict=True)]
    assert got == sorted(s for strings, _ in made for s in strings)
    assert prefix[1:] == [next((k for k in range(6) if x[k] != y[k]), 6) for x, y in zip(got, got[1:])]


# 10: byte-level BPE


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([" ", "  ", "\n", "\t", "'s", "a", "The", "1", ".", "é", "日", "<|endoftext|>", "\xa0"]), st.characters(exclude_categories=["Cs"])), max_size=30).map("".join))
def test_bpe(text):
    v = bpe.vocabulary(queries.BPE)
    want = TOKENIZER.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(v.encode(text), "<u4").tolist() == want
    assert v.decode(v.encode(text)).decode() == TOKENIZER.decode(want, skip_special_tokens=False)


def test_bpe_columns(docs, rows, nothing):
    ids = bpe.encode_column(docs, queries.BPE)
    assert Counter(tuple(r) for r in bpe.decode_column(ids, queries.BPE).collect()) == Counter((r[0], r[1] or "") for r in rows)
    got = bpe.round_trip(docs, queries.BPE).collect()
    same_rows(got, rows)
    assert bpe.round_trip(nothing, queries.BPE).count() == 0


# 11: importance resampling


def _words(text):
    return [w.decode() for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())]


def _resampled(rows, target, percent, least, seed=7, k=10_000):
    """doc_id, n_features, weight, score and rank by the definition; rows in any order."""
    feats = lambda w: w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
    of = [feats(_words(t)) for _, t in rows]
    s, t = (Counter(zlib.crc32(f.encode()) % k for fs in x for f in fs) for x in (of, [feats(_words(x)) for x in target]))
    big, small = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big + k) / ((s[b] + 1) * (small + k)))) for b in range(k)]
    out = []
    for (i, text), fs in zip(rows, of, strict=True):
        weight = sum(gain[zlib.crc32(f.encode()) % k] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(_words(text)) >= least))
    order = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    drawn = percent * len(order) // 100
    ranked = [(*x[:4], k + 1 if k < drawn else None) for k, x in enumerate(order)]
    return Counter(ranked + [(*x[:4], None) for x in out if not x[4]])


@pytest.mark.parametrize(("percent", "least", "ranges"), [(25, 20, 500_000), (60, 1, 7), (100, 0, 5), (0, 20, 5)])
def test_resampling(spark, docs, rows, monkeypatch, percent, least, ranges):
    monkeypatch.setattr(resample, "ROWS_A_RANGE", ranges)
    target = ["ab cab dad", None, "", rows[3][1], "È ÀB été\x00a1b"]
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resample(docs, goal, percent, least).collect()
    want = _resampled([r[:2] for r in rows], target, percent, least)
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in got) == want
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len([x for x in want.elements() if x[4]]) + 1))


def test_resampling_of_copies_and_of_nothing(spark, docs, nothing, rows):
    hot = spark.createDataFrame([(1, "one two three " * 9)] * 200 + [(None, "four five six " * 9)] * 100 + [(2, "seven")], "doc_id long, text string")
    goal = spark.createDataFrame([("one two",)], "text string")
    got = resample.resample(hot, goal, 50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 151)) and len(got) == 301
    assert resample.resample(nothing, goal).count() == 0
    assert resample.resample(docs, nothing.select("text")).count() == len(rows)


# 12: SimHash


def _fingerprint(text):
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if w]
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _simhash_classes(pairs, most=4):
    """The least id that each (id, fingerprint) reaches, over all pairs."""
    root = {f: f for _, f in pairs}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in itertools.combinations(root, 2):
        if (a ^ b).bit_count() <= most:
            root[find(a)] = find(b)
    least = {}
    for i, f in pairs:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return Counter((i, f"{f:016x}", least.get(find(f))) for i, f in pairs)


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ABab\u00c9\u00a0 \t\n\v\x1c", max_size=60))
def test_simhash_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == _fingerprint(text)


def test_simhash_of_awkward_rows(docs, rows, nothing):
    got = Counter(map(tuple, simhash.components_of(docs).collect()))
    assert got == _simhash_classes([(r[0], _fingerprint(r[1])) for r in rows])
    assert simhash.components_of(nothing).count() == 0
    long = ("The END of it\t" * 40_000).encode()
    assert simhash.fingerprint(long) == _fingerprint(long.decode())


def _prints(spark, values):
    return spark.createDataFrame([(int(v) - (1 << 64) if int(v) >> 63 else int(v),) for v in sorted(set(map(int, values)))], "fp long")


@pytest.mark.parametrize("block", [5, 2048])
def test_simhash_links_lose_nothing(spark, block):
    """Fingerprints in chains of few differing bits, just within and just beyond the limit, and strangers."""
    rng = random.Random(12)
    values = [0, 1, 31, 63, (1 << 64) - 1]
    for _ in range(60):
        v = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            values.append(v)
            for b in rng.sample(range(64), rng.choice([1, 3, 4, 4, 5, 6])):
                v ^= 1 << b
    found = simhash.links(_prints(spark, values), len(set(values)), block=block).collect()
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 4 for a, b in found)
    linked = {v: v for v in values}

    def find(v):
        while linked[v] != v:
            v = linked[v]
        return v

    for a, b in found:
        linked[find(a % (1 << 64))] = find(b % (1 << 64))
    whole = _simhash_classes([(k, v) for k, v in enumerate(values)])
    least = {}
    for k, v in enumerate(values):
        least[find(v)] = min(k, least.get(find(v), k))
    assert Counter((k, f"{v:016x}", least[find(v)]) for k, v in enumerate(values)) == whole


def test_simhash_meets_in_one_block_pair_at_a_time(spark):
    """A key with many fingerprints is dealt out: no group has more than two blocks, and one link a fingerprint is given at most."""
    base = 0x0123456789ABCDEF
    values = {base ^ (1 << a) ^ (1 << b) for a in range(30, 64) for b in range(a)}
    distinct = _prints(spark, values)
    keys = simhash.keyed(distinct)
    groups = simhash.grouped(keys, 10 * len(values), block=50).groupBy("which", "bits", "pair").count()
    assert groups.agg({"count": "max"}).first()[0] <= 150
    assert simhash.links(distinct, len(values)).groupBy("a", "b").count().filter("a = b").isEmpty()
    assert len(simhash.links_of(np.array(sorted(values), np.uint64), 0)) < len(values)


@given(st.integers(0, (1 << 64) - 1), st.sets(st.integers(0, 63), max_size=4))
def test_simhash_ring_has_a_start_for_every_near_pair(v, bits):
    """Two fingerprints within the limit share a key, and keep to the budgets of all chains from its start."""
    apart = sum(1 << b for b in bits)
    keep = lambda start: all((apart & m).bit_count() <= 4 * k // 5 for k, m in enumerate(simhash.chain_masks(start), 1))
    assert any(apart & m == 0 and keep(start) for start, m in simhash.key_masks())
