"""Every operator against a plain version on a table with nulls, empty, long, equal and repeated texts, and clashing columns."""

import collections
import hashlib
import random
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest

from candlework.llm import bpe, decontaminate, html_text, kneser_ney, near_duplicates, quality, sharding, suffix_dedup, token_counts, token_files
from candlework.llm.common import BYTE_TOKENIZER, WORD_TOKENIZER, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, n_tokens string, name int, kept string, spans string, shard string, bands string, places int"


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéü") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 160))) for _ in range(n)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(110))
    for k in range(0, n, 5):
        texts[k] = texts[k] + "\n" + passage + " " + str(k)
    for k in range(1, n, 7):
        w = texts[0].split(" ")
        w[k % len(w)] = "changed"
        texts[k] = " ".join(w)
    odd = [None, None, "", "", " \t\n", "a", "x" * 3000, "ab" * 900, texts[3], texts[3], "İſ가각 don't <|endoftext|> 12 \x1c  ", "line one\nline one\n\nline one", "A B c " * 400]
    rows = [(k + 1, t, ("en", "de", None)[k % 3], "x", 1, "y", "z", "s", "b", 7) for k, t in enumerate(texts + odd)]
    rows.append(rows[4])  # a repeated row
    rows.append((None, "no id of its own but words enough for a shingle", None, None, None, None, None, None, None, None))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def counted(df, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_token_counts_of_sections(docs, rows, empty):
    path = tokenizer_path(BYTE_TOKENIZER)
    library = bpe.load_tokenizer(path)
    library.encode_special_tokens = True
    got = collections.Counter()
    shared = collections.Counter()
    for r in token_counts.section_token_counts(docs, path).collect():
        got[r["doc_id"]] += r["n_tokens"]
        shared[r["doc_id"]] += r["n_shared"]
    want = collections.Counter()
    for i, t in rows:
        want[i] += len(library.encode(t or "", add_special_tokens=False).ids)
    assert +got == +want
    assert all(abs(shared[i] - want[i]) < 1e-6 for i in want)
    assert token_counts.section_token_counts(empty, path).count() == 0


def test_boundary_tokens_go_by_the_rule():
    owned, crossing, shared = token_counts.attribute(np.array([0, 2, 6]), np.array([2, 6, 7]), np.array([[0, 3], [3, 4], [4, 7]]))
    assert owned.tolist() == [2, 0, 1] and crossing.tolist() == [1, 1, 1]
    assert shared.tolist() == [1.25, 0.25, 1.5]


@pytest.mark.parametrize("leaf,piece", [(8, 40), (4096, 65536)])
def test_bpe_equals_the_library(docs, rows, empty, leaf, piece):
    path = tokenizer_path(WORD_TOKENIZER)
    library = bpe.load_tokenizer(path)
    want = collections.Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert counted(bpe.encode_documents(docs, path, leaf_chars=leaf, piece_chars=piece), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert bpe.encode_documents(empty, path).count() == 0


def test_trees_of_random_texts():
    path = tokenizer_path(WORD_TOKENIZER)
    own, library = bpe.Encoder(path), bpe.load_tokenizer(path)
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab'stre !?é́İſ가각ᄀ한字漢😀 \x1c  \n\t\x0b\x0c.1२<|endoftext|>") for _ in range(rng.randint(0, 90))) for _ in range(600)]
    texts.append("".join(rng.choice("abcdefgh") for _ in range(9000)))
    for leaf in (6, 16):
        for text, (ids, starts) in zip(texts, own.trees(texts, [0] * len(texts), leaf)):
            want = library.encode(text, add_special_tokens=False)
            assert ids.tolist() == want.ids, text
            assert starts.tolist() == [a for a, _ in want.offsets], text


def test_token_files_round_trip(spark, docs, rows, empty):
    path = tokenizer_path(WORD_TOKENIZER)
    library = bpe.load_tokenizer(path)
    got = token_files.token_rows(spark, token_files.write_token_files(docs, path, block_ids=700)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got[:-1]]).tolist()
    want = collections.Counter()
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[(i, len(ids), zlib.crc32(ids.tobytes()))] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert token_files.token_rows(spark, token_files.write_token_files(empty, path)).count() == 0


def test_elias_fano_select():
    rng = np.random.default_rng(1)
    for n, top in ((1, 0), (5, 3), (1000, 50), (3000, 10**9), (700, 10**5)):
        values = np.sort(rng.integers(0, top + 1, n))
        e = token_files.EliasFano.of(values)
        assert e.all().tolist() == values.tolist()
        assert [e.select(i) for i in range(0, n, 7)] == values[::7].tolist()
    with pytest.raises(ValueError):
        token_files.unpack(token_files.pack(0, [np.array([1, 2], "<u4")])[:-1])


def test_html_main_text(spark):
    def page(k, body):
        return (k, f"https://Site.example/{k}", f"<html><head><title>t</title></head><body><nav>menu</nav><div id='x'>Buy our things</div><main>{body}</main><footer>f</footer></body></html>")

    pages = [page(k, f"<div>Box of the site</div><p>text {k} &amp;&nbsp; more<p>Reprinted<br>prose<div class='comments'><p>me too</div>") for k in range(12)]
    pages += [(90, None, None), (91, "", ""), (92, "odd", "<p>a<script>var t='</p>'</script> b</p><li>c<form>q</form>"), (93, "https://site.example/z", "<article><h1>T&eacute;</h1> x\n y <aside>s</aside><p>z")]
    frame = spark.createDataFrame([(*p, 5) for p in pages + [pages[0]]], "page_id long, url string, html string, text int")
    got = html_text.extract(frame)
    texts = {r["page_id"]: (r["text"], r["n_chars"]) for r in got.collect()}
    assert texts[3][0] == "text 3 & more\nReprinted prose"
    assert texts[90] == texts[91] == ("", 0)
    assert texts[92][0] == "a b\nc"
    assert texts[93] == ("Té\nx y\nz", 8)
    assert got.count() == len(pages) + 1
    assert html_text.extract(spark.createDataFrame([], frame.schema)).count() == 0


@pytest.mark.parametrize(
    "body,want",
    [
        ("<div class='layout has-sidebar'><article><p>a</article></div>", "a"),
        ("<article class='post comment-open'><p>a</article>", "a"),
        ("<article class='comments'><p>a</article>", "a"),
        ("<div class='sidebar'><form><article><p>a</article></form></div><div class='cookie-banner'>c</div>", "a"),
        ("<article><p class='share-price'>12 up</p><p>a<div class='share'>s</div><div class='social-share'>t</div></article>", "12 up\na"),
        ("<article><p>a</article><aside><article>card</article></aside><article><p>longer b</article>", "a\nlonger b"),
        ("<article>a<svg class='x' viewBox='0 0 1 1'/> b <math/>c<svg><text>no</text></svg></article>", "a b c"),
        ("<article>a <svg-icon>i</svg-icon> b<template-x name='t'> c</template-x></article>", "a i b c"),
        ("<div id='main-content'>a</div><div class='main-nav'>n</div>", "a"),
        ("<div class='sidebar'>s</div><div class='header'>h</div>a<nav>n</nav>", "a"),
    ],
)
def test_wrappers_and_names_keep_the_article(body, want):
    assert html_text.main_text(f"<html><body>{body}</body></html>") == want


def site(rng, n=90):
    """Pages of three hosts (one of a few pages) put together from common and own pieces."""
    common = ["<div>Box</div>", "<div>Share this<div>now</div></div>", "<ul><li>home</li><li>news</li></ul>", "<p>Subscribe to our letter</p>", "<li>again</li>"]
    own = lambda k: rng.choice([f"<p>text {k} {rng.randrange(99)}</p>", f"<ul><li>item {k}</li><li>again</li></ul>", f"<div>piece {k}</div>", "<div><p>reprinted</p></div>", "<p>reprinted</p>", f"bare {k}"])
    pages = []
    for k in range(n):
        host = ("big.example", "mid.example", "few.example")[0 if k % 3 else 1 if k % 9 else 2]
        inside = "".join(rng.sample(common, rng.randint(0, 3)) + [own(k) for _ in range(rng.randint(1, 4))] + rng.sample(common, rng.randint(0, 3)))
        around = "".join(rng.sample(common, 2))
        pages.append((k, f"https://{host}/{k}", around + (f"<article>{inside}</article>" if k % 4 else inside) + "<div>end of page</div>"))
    return pages


@pytest.mark.parametrize("broadcast_rows", [html_text.BROADCAST_ROWS, 0])
def test_templates_equal_plain_counts(spark, broadcast_rows):
    pages = site(random.Random(6))
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    want = brute.page_texts(pages, html_text.MIN_PAGES)
    got = {r["page_id"]: r["text"] for r in html_text.extract(frame, broadcast_rows=broadcast_rows).collect()}
    assert got == want
    assert any("again" in t for t in got.values()) and not any("end of page" in t for k, t in got.items() if k % 4 and k % 9)


def test_templates_do_not_depend_on_the_size_of_the_host(spark):
    pages = [(k, f"https://a.example/{k}", f"<article><div>note</div><p>text {k}</p></article>" if k < 9 else f"<article><p>text {k}</p></article>") for k in range(400)]
    texts = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert texts == {k: f"text {k}" for k in range(400)}


def test_quality_base_counts(spark, docs, rows, empty):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    got = quality.verdicts(docs, labels)
    want = collections.Counter()
    for i, t in rows:
        c = brute.base_counts(t)
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        want[(i, *c, failed, not failed)] += 1
    assert counted(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept") == want
    assert quality.verdicts(empty, labels).count() == 0
    kept = quality.keep_good(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == sum(n for k, n in want.items() if k[-1])


def test_cutoffs_hold_the_risk(spark):
    rng = random.Random(2)
    rows = []
    for k in range(6000):
        bad = k % 6 == 0
        rows.append((k, " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) + ("### " if bad and rng.random() < 0.5 else "") for _ in range(60)), "en"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, int(k % 6 != 0)) for k in range(6000)], "doc_id long, quality int")
    got = {r["doc_id"]: r["kept"] for r in quality.verdicts(docs, labels).collect()}
    assert sum(not got[k] for k in got if k % 6) <= 0.002 * 5000 * len(quality.SCORES)
    assert sum(not got[k] for k in got if k % 6 == 0) > 900


def test_small_strata_get_cutoffs(spark):
    rng = random.Random(8)
    sizes = {"es": (320, 30), "xx": (200, 20)}  # good and bad labels; 10 tests need 263 good ones
    rows, good = [], {}
    for lang, (n, m) in sizes.items():
        for k in range(n + m):
            text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) + (" $$$" if k >= n and rng.random() < 0.6 else "") for _ in range(80))
            good[len(rows)] = k < n
            rows.append((len(rows), text, lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, int(g)) for k, g in good.items()], "doc_id long, quality int")
    kept = {r["doc_id"]: r["kept"] for r in quality.verdicts(docs, labels).collect()}
    assert not any(kept[k] for k, _, lang in rows if lang == "es" and not good[k])
    assert sum(not kept[k] for k, _, lang in rows if lang == "es" and good[k]) <= 0.02 * 320
    assert all(kept[k] for k, _, lang in rows if lang == "xx")


def test_shards_are_minimax(docs, rows, empty):
    got = sharding.shard_documents(docs).collect()
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    sizes = collections.Counter()
    for _, t in rows:
        sizes[hashlib.md5((t or "").encode()).hexdigest()] += len((t or "").encode()) + 1
    filled = collections.Counter()
    slots = collections.defaultdict(list)
    for r in got:
        filled[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert max(filled.values()) == brute.capacity([sizes[k] for k in sorted(sizes)], 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(empty).count() == 0


def test_shards_split_cells_until_exact(spark):
    rng = random.Random(9)
    for n in (1, 3, 40, 1500):
        names = sorted({hashlib.md5(str(rng.random()).encode()).hexdigest() for _ in range(n)})
        sizes = [rng.choice([1, 5, 50, 3000]) for _ in names]
        groups = spark.createDataFrame(list(zip(names, sizes)), "name string, bytes long")
        assert sharding.minimax_cuts(groups, 7)[0] == brute.capacity(sizes, 7)


def test_suffix_removal_equals_brute_force(docs, rows, empty):
    want = collections.Counter((i, *c) for (i, _), c in zip(rows, brute.cut([t for _, t in rows], 400)))
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert counted(suffix_dedup.removed_bytes(docs), *columns) == want
    assert counted(suffix_dedup.removed_bytes(docs, group_rows=2), *columns) == want
    assert suffix_dedup.removed_bytes(empty).count() == 0
    left = suffix_dedup.without_repeats(docs)
    assert left.columns == docs.columns and left.where("doc_id = 67").count() == 0  # the text of one letter goes as a whole


def test_deep_shallow_sort_and_reaches():
    rng = random.Random(4)
    for turn in range(150):
        strings = ["".join(rng.choice(rng.choice(("a", "ab", "abc"))) for _ in range(rng.randint(0, 70))).encode() for _ in range(rng.randint(1, 30))]
        strings = [b"x" * 60 + s for s in strings] if turn % 3 == 0 else strings
        order, shared = suffix_dedup.deep_shallow(strings)
        assert [strings[i] for i in order] == sorted(strings) and sorted(order) == list(range(len(strings)))
        assert all(shared[k] == suffix_dedup.common(strings[order[k - 1]], strings[order[k]]) for k in range(1, len(order)))
        lefts = [s[:20] for s in rng.sample(strings, len(strings))]
        for i, got in enumerate(suffix_dedup.reaches(lefts, strings, 30)):
            pairs = [(suffix_dedup.common(lefts[i], lefts[j]), suffix_dedup.common(strings[i], strings[j])) for j in range(len(strings)) if j != i]
            pairs = [p for p in pairs if sum(p) >= 30]
            assert got == (max((p[0] for p in pairs), default=0), max((p[1] for p in pairs), default=0))


def test_near_duplicates_equal_all_pairs(docs, rows, empty):
    named = list({(i, t) for i, t in rows if i is not None})
    want = brute.classes(sorted(named, key=lambda r: r[0]))
    got = near_duplicates.near_duplicate_classes(docs)
    assert {r["doc_id"]: r["class_id"] for r in got.collect() if r["doc_id"] is not None} == want
    assert got.count() == len(rows)
    assert near_duplicates.near_duplicate_classes(empty).count() == 0
    kept = near_duplicates.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(set(want.values()))


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    for n, changed, top in ((300, 30, 1), (40, 5, 1), (500, 60, 6), (5, 1, 9)):
        ids, weights = rng.integers(1, 2**63, n + changed).astype(np.uint64), rng.integers(1, top + 1, n + changed)
        a, b = np.arange(n), np.arange(changed, n + changed)
        text = np.repeat([0, 1], n)
        got = near_duplicates.dart_signatures(text, ids[np.r_[a, b]], weights[np.r_[a, b]], 2, 8000)
        true = weights[changed:n].sum() / weights.sum()
        assert abs((got[0] == got[1]).mean() - true) < 5 * (true * (1 - true) / 8000) ** 0.5


def test_overlaps_equal_every_diagonal(spark, docs, rows, empty):
    rng = random.Random(3)
    source = [t.split() for _, t in rows if t and len(t.split()) > 60]
    items = []
    for k in range(20):
        w = list(rng.choice(source)[5 : 5 + rng.randint(3, 45)])
        for p in range(6, len(w), 9):
            w[p] = "other"
        items.append((k, " ".join(w).upper() if k % 2 else " ".join(w)))
    items += [(20, None), (21, ""), (3, items[3][1]), (None, "no id")]
    benchmark = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    lower = lambda t: brute.words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    least, most = {}, {}
    for i, t in set(rows):
        d = lower(t)
        for j, s in set(items):
            q = lower(s)
            if j is None or not q or not d:
                continue
            best, through = 0, 0
            for shift in range(-len(q) + 1, len(d)):
                same = np.array([d[p + shift] == q[p] for p in range(max(0, -shift), min(len(q), len(d) - shift))])
                sums = np.concatenate([[0], np.cumsum(np.where(same, 1, -4))])
                stretch = lambda k: (int(np.argmin(sums[: k + 1])), k + 1 + int(np.argmax(sums[k + 1 :])))
                spans = [stretch(k) for k in np.flatnonzero(same)]
                if spans:
                    a, b = max(spans, key=lambda x: sums[x[1]] - sums[x[0]])
                    best = max(best, int(same[a:b].sum()))
                    through = max(through, *[int(same[x:y].sum()) for x, y in spans])
            if best >= min(12, len(q)):
                least[(i, j)] = best
            if through >= min(12, len(q)):
                most[(i, j)] = through
    got = {(r["doc_id"], r["item_id"]): r["n_matched"] for r in decontaminate.overlaps(docs, benchmark).collect()}
    # A stretch goes through a seed's hit: never less than the best of its diagonal, never more than through any match.
    assert set(least) <= set(got) <= set(most) and len(least) > 15
    assert all(got[k] >= v for k, v in least.items()) and all(v <= most[k] for k, v in got.items())
    small = {(r["doc_id"], r["item_id"]): r["n_matched"] for r in decontaminate.overlaps(docs, benchmark, slice_words=40).collect()}
    assert small == got
    want = got
    assert decontaminate.overlaps(empty, benchmark).count() == decontaminate.overlaps(docs, benchmark.limit(0)).count() == 0
    clean = decontaminate.keep_clean(docs, benchmark)
    assert clean.columns == docs.columns and collections.Counter(r["doc_id"] for r in clean.collect()) == collections.Counter(i for i, _ in rows if i not in {i for i, _ in want})


def planted_copies(length, changes, rng):
    """Share of items found in texts that hold a copy with words at ``changes(rng)`` replaced."""
    items = [[f"w{rng.randrange(5000)}" for _ in range(length)] for _ in range(300)]
    seeds = decontaminate.Seeds([(k, " ".join(w)) for k, w in enumerate(items)], share=decontaminate.SHARE)
    texts = []
    for w in items:
        w = list(w)
        for p in changes(rng):
            w[p] = "other"
        texts.append(" ".join([f"v{rng.randrange(5000)}" for _ in range(20)] + w + [f"v{rng.randrange(5000)}" for _ in range(20)]))
    found = seeds.overlaps(pa.array(texts))
    assert all(t == item for t, item, *_ in found)
    return len(found) / len(items)


def test_planted_substitutions_are_found():
    for length in (8, 9, 11, 12, 13, 15):
        for p in range(length):
            assert planted_copies(length, lambda rng: [p], random.Random(p)) == 1, (length, p)  # noqa: B023
    for length, rate, least in ((15, 0.1, 0.9), (20, 0.1, 0.97), (20, 0.15, 0.9), (38, 0.15, 0.98), (38, 0.2, 0.94)):
        got = planted_copies(length, lambda rng: [p for p in range(length) if rng.random() < rate], random.Random(1))  # noqa: B023
        assert got >= least, (length, rate, got)


def test_short_items_are_found_at_fifteen_per_cent():
    for length in (10, 12, 15, 20):
        got = planted_copies(length, lambda rng: [p for p in range(length) if rng.random() < 0.15], random.Random(2))  # noqa: B023
        assert got >= 0.9, (length, got)


@pytest.mark.parametrize("pairs", [decontaminate.PAIRS, 1000])
def test_periodic_texts_cost_their_diagonals(monkeypatch, pairs):
    monkeypatch.setattr(decontaminate, "PAIRS", pairs)
    seeds = decontaminate.Seeds([(1, " ".join(["buy", "now"] * 100)), (2, "one two three four five six seven eight nine ten eleven twelve")], share=decontaminate.SHARE)
    texts = pa.array([" ".join(["buy", "now"] * 1500), "a b c", "one two three four five six seven eight nine other eleven twelve"])
    words, hashes = decontaminate.word_hashes(texts, lower=True)
    met = seeds.diagonals(words, hashes)
    assert len(met) == len(set(met)) <= 3000 + 200 + 24
    assert sorted(seeds.overlaps(texts)) == [(0, 1, 0, 0, 200, 200), (2, 2, 0, 0, 12, 11)]


def test_scores_equal_plain_kneser_ney(docs, rows, empty):
    got = kneser_ney.score_documents(docs).collect()
    want = brute.kneser_ney(rows, kneser_ney.discounts)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:5])
    plain = sorted(((i, *w) for (i, _), w in zip(rows, want)), key=key)
    found = sorted((tuple(r) for r in got), key=key)
    assert [r[:5] for r in found] == [r[:5] for r in plain]
    assert all(abs(a - b) < 1e-6 for f, p in zip(found, plain) for a, b in zip(f[5:], p[5:]))
    assert kneser_ney.score_documents(empty).count() == 0


def test_packed_blocks_round_trip():
    keys = np.array([-5, 0, 3, 2**62], np.int64)
    assert [a.tolist() for a in kneser_ney.unsqueeze(kneser_ney.squeeze(keys, keys * 0 + 7))] == [keys.tolist(), [7] * 4]
    assert token_counts.line_sections("").tolist() == [[0, 0]]
    assert bpe.Encoder(tokenizer_path(WORD_TOKENIZER)).words.encode_texts(pa.array([], pa.string()), False)[0].tolist() == [0]
