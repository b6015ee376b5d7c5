"""Local search, phrases and periodic runs against brute force, with nulls, empty texts, ties, repeats, long texts and clashing columns."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import archive, batches, local_search, periodic_runs, phrases, site_style
from lectern.llm.tokens import Encoder

SCHEMA = "doc_id long, text string, LENGTH string, piece string"


def test_local_search_packs_every_id_once(spark):
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcde", k=rng.randint(1, 9))) for _ in range(rng.choice([0, 1, 90, 300, 2500]))) for _ in range(120)]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(500, None, None, ""), (501, "", "", None), (3, texts[3], "x", "y"), (None, "a b", "", "")]
    out = local_search.pack(spark.createDataFrame(rows, SCHEMA).repartition(5), group=8, with_ids=True).collect()
    code = Encoder("word_bpe_49k.json")
    whole = {(d, code.whole(t or "") + bytes(4)) for d, t, *_ in rows}
    by_doc, by_sequence = {}, {}
    for r in out:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length and r.start == 2048 * r.piece
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, ids in whole:
        pieces = sorted(by_doc[d], key=lambda r: r.piece)
        assert len({r.piece for r in pieces}) * (2 if d == 3 else 1) == len(pieces) == max(1, -(-len(ids) // 8192)) * (2 if d == 3 else 1)
        assert b"".join(bytes(r.ids) for r in pieces[:: 2 if d == 3 else 1]) == ids
    for spans in by_sequence.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))] and sum(n for _, n in spans) <= 2048
    assert len(by_sequence) <= -(-sum(r.length for r in out) // 2048) + 2
    assert local_search.pack(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("low, high, n", [(600, 760, 300), (300, 900, 2500), (1, 2047, 400), (1, 3, 5000), (1100, 2000, 50)])
def test_local_search_improves_best_fit(low, high, n):
    length = np.random.default_rng(low).integers(low, high + 1, n)
    first = local_search.best_fit(length, 2048)
    found = local_search.LocalSearch(length, first, 2048)
    squares = (found.fill**2).sum()
    where = found.run()
    fill = np.bincount(where, weights=length)
    assert fill.max() <= 2048 and (fill**2).sum() >= squares
    bins, before = (fill > 0).sum(), len(np.unique(first))
    assert local_search.least_bins(length, 2048) <= bins <= before
    assert bins < before or low not in (300, 600)


def test_each_exchange_empties_a_bin():
    for length, where in (([1000, 1040, 900, 960, 180], [0, 1, 0, 1, 2]), ([1200, 800, 700, 600, 500, 240], [0, 0, 1, 1, 1, 2]), ([1000, 900, 600, 500, 400, 300, 200], [0, 0, 1, 1, 1, 2, 2])):
        found = local_search.LocalSearch(np.array(length), np.array(where), 2048)
        before = (found.fill**2).sum()
        found.run()
        assert (found.fill**2).sum() > before and found.fill.max() <= 2048


def brute_least(length, size):
    best = [len(length)]

    def go(i, fills):
        if len(fills) >= best[0]:
            return
        if i == len(length):
            best[0] = len(fills)
            return
        for k in range(len(fills)):
            if fills[k] + length[i] <= size:
                go(i + 1, [*fills[:k], fills[k] + length[i], *fills[k + 1 :]])
        go(i + 1, [*fills, length[i]])

    go(0, [])
    return best[0]


def test_bound_is_never_above_the_least_number_of_bins():
    rng = random.Random(2)
    for _ in range(200):
        length = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 8))), reverse=True)
        least = brute_least(length, 20)
        assert local_search.least_bins(np.array(length), 20) <= least <= len(np.unique(local_search.search(np.array(length), 20)))


def brute_phrases(rows, least=10, longest=3, covered=50, top=2000):
    counts, words = {}, Counter()
    for lang, text in rows:
        low = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or "")
        own = counts.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            words[lang or "und"] += len(w)
            for m in range(1, longest + 1):
                own.update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        ranked = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(ranked)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, words[lang], -s))
    return sorted(out)


def phrase_rows(seed, n=150):
    rng = random.Random(seed)
    vocabulary = ["the", "Of", "new", "york", "é", "É", "aa", "a" * 40, "x y", "½"] + [f"w{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    rows = []
    for i in range(n):
        w = rng.choices(vocabulary, weights, k=rng.randint(0, 90))
        if i % 3 == 0:
            w[2:2] = ["rare", f"twin{i % 4}", "pair"] * rng.randint(1, 2)
        rows.append((i, "".join(x + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\x0b", "? "]) for x in w), rng.choice(["en", "en", "de", None, "und"])))
    return [*rows, (n, None, "en"), (n + 1, "", None), (None, "aa aa aa aa " * 9, "en"), *[(7, "same row again and again", "fr")] * 12]


@pytest.mark.parametrize("sampled", [1, 4, 50])
def test_phrases_equal_brute_force(spark, sampled):
    rows = phrase_rows(sampled)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, PHRASE string")
    want = brute_phrases([(r[2], r[1]) for r in rows])
    got = sorted(tuple(r) for r in phrases.collocations(df, sampled=sampled).collect())
    assert got == want and len(want) > 20
    assert [tuple(r) for r in phrases.collocations(df, sampled=sampled, top=3).orderBy("lang", "rank").collect()] == sorted(brute_phrases([(r[2], r[1]) for r in rows], top=3))


def test_failures_of_the_border_lead_to_further_passes(spark):
    rows = phrase_rows(9)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    folder = batches.shared_folder(spark, "t")
    found, _, failed = phrases.frequent_phrases(df, folder, sampled=1)
    assert failed == [0]
    again, _, failed = phrases.frequent_phrases(df.where("true"), folder, sampled=1000)
    assert len(failed) >= 2 and failed[0] > 0 and failed[-1] == 0
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, again.collect()))


def test_phrases_of_four_words_and_full_filters(spark, monkeypatch):
    rows = phrase_rows(4)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(phrases, "MOST_BITS", 64 * 64)
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 500)
    monkeypatch.setattr(phrases, "MERGED_CHUNKS", 2)
    got = sorted(tuple(r) for r in phrases.collocations(df, longest=4, least=6, sampled=3).collect())
    assert got == brute_phrases([(r[2], r[1]) for r in rows], least=6, longest=4)
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert phrases.collocations(empty).collect() == []


def test_words_and_their_hashes_on_whole_arrays():
    texts = ["", "One two\ttwo  é;É\n\n", " x\x00y " + "Long" * 90 + " a", ". , 12345678 123456789 \u3000", "one"]
    raw = [t.encode() for t in texts]
    ids, names = phrases._words(raw)
    low = b"\n".join(raw).lower()
    assert [w for w in names.take(pa.array(ids)).to_pylist() if w != b"\n"] == [w for w in re.split(b"[ \t.,;:!?\n]+", low) if w]
    assert names[0].as_py() == b"\n" and ids[0] == 0
    hashes = phrases._word_hashes(names, phrases._seed("en"))
    assert len(set(hashes.tolist())) == len(names)
    assert phrases._word_hashes(names[3:5], phrases._seed("en")).tolist() == hashes[3:5].tolist()
    assert not set(hashes.tolist()) & set(phrases._word_hashes(names, phrases._seed("de")).tolist())
    spelt = ["one two", "one", "two two é"]
    of = dict(zip(names.to_pylist(), hashes, strict=True))
    two = phrases._joined(np.array([of[b"one"], of[b"two"]]), np.array([of[b"two"]] * 2))
    want = [two[0], of[b"one"], phrases._joined(two[1:], np.array([of["é".encode()]]))[0]]
    assert phrases._phrase_hashes(pa.array(spelt), pa.array(["en"] * 3)).tolist() == want


def test_phrases_are_dealt_packed(spark):
    """A task sends a value for each bucket, language and chunk, not a row for each phrase of a chunk."""
    rows = [(" ".join(f"w{(i * j) % 997}" for j in range(300)).encode(), "en") for i in range(1, 41)]
    docs = spark.createDataFrame(rows, "raw binary, lang string").coalesce(1)
    counted = phrases.count_phrases(docs, {1: [], 2: []}, range(1), range(1, 4), 1, 1)
    assert sorted(map(tuple, counted.where("m < 2").collect())) == sorted([("en", 0, "", 12000), *(("en", 1, w.decode(), n) for w, n in Counter(w for r, _ in rows for w in r.split()).items())])
    assert "HashAggregate" not in counted._jdf.queryExecution().executedPlan().toString()


def test_phrases_over_false_hits_of_an_earlier_filter(spark):
    """Names of one document each, mostly unknown to the sample, before words that it knows: the sample's filter holds some of 'name the' falsely."""
    rows = [(i, ". ".join([f"u{i} the of"] * 11 + ["the of and the of"] * 3), "en") for i in range(1500)]
    got = sorted(tuple(r) for r in phrases.collocations(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect())
    assert got == brute_phrases([(r[2], r[1]) for r in rows])


def test_a_language_of_empty_texts_alone(spark):
    rows = [(1, "a b c. " * 20, "en"), (2, "", "de"), (3, None, "fr"), (4, "one", "es")]
    got = sorted(tuple(r) for r in phrases.collocations(spark.createDataFrame(rows, "doc_id long, text string, lang string"), longest=4).collect())
    assert got == brute_phrases([(r[2], r[1]) for r in rows], longest=4)


def brute_runs(words, least=24, exponent=3):
    n, runs = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q):
                runs.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, m, q) for (s, m), q in runs.items())


def brute_row(doc, text, planted):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    if planted and doc is not None and words and zlib.crc32(str(doc).encode()) % 10 == 0:
        g = zlib.crc32(str(doc).encode()) // 10
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]
    runs = brute_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def periodic_words(rng, depth=0):
    kind = rng.random()
    if kind < 0.3:
        return [f"w{rng.randrange(rng.choice([1, 2, 1000]))}" for _ in range(rng.randrange(1, 60))]
    if kind < 0.7 or depth > 3:
        block = [f"w{rng.randrange(rng.choice([1, 2, 1000]))}" for _ in range(rng.randrange(1, 40))]
        return (block * 8)[: rng.randrange(1, len(block) * 8)]
    if kind < 0.85:
        return periodic_words(rng, depth + 1) * rng.randrange(2, 5)
    return periodic_words(rng, depth + 1) + periodic_words(rng, depth + 1)


@pytest.mark.parametrize("tile", [1 << 17, 64, 200])
def test_periodic_runs_equal_brute_force(spark, tile):
    rng = random.Random(tile)
    rows = [(i, rng.choice([" ", "\n", "\t\x0b "]).join((periodic_words(rng) + periodic_words(rng))[:900]), "x", "y") for i in range(150)]
    rows += [(200, None, "x", "y"), (201, "", "x", "y"), (None, "a b c " * 20, "x", "y"), (3, rows[3][1], "x", "y"), (3, rows[3][1], "x", "y"), (202, "é b " * 30, "x", "y"), (-7, "a " * 24, "x", "y"), (203, "a " * 23, "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, UID string, found string").repartition(3)
    for planted in (True, False):
        got = sorted((tuple(r) for r in periodic_runs.find_runs(df, planted=planted, tile=tile).collect()), key=str)
        assert got == sorted((brute_row(d, t, planted) for d, t, *_ in rows), key=str)
    assert periodic_runs.find_runs(df.limit(0)).collect() == []


def test_windows_of_equal_hash_are_compared(monkeypatch):
    rng = random.Random(1)
    for name in ("_mixed",):
        monkeypatch.setattr(periodic_runs, name, lambda x: x % np.uint64(3))  # nearly all windows look alike
    for _ in range(60):
        words = periodic_words(rng)[:300]
        known: dict = {}
        w = np.array([known.setdefault(x, len(known)) for x in words], np.int64)
        found: dict = {}
        for p, x, y in periodic_runs.solve(w, 1, len(w) // 3 + 1):
            found[x, y + p - x] = min(p, found.get((x, y + p - x), p))
        assert sorted((s, m, p) for (s, m), p in found.items()) == brute_runs(words)


def test_a_long_document_is_solved_by_tiles():
    rng = np.random.default_rng(4)
    block = rng.integers(0, 1 << 30, 90_000)
    w = np.concatenate([rng.integers(0, 1 << 30, 10_000), block, block, block, block[:5_000], np.zeros(50_000, np.int64)])
    cut = periodic_runs.tiles(len(w), size=1 << 15)
    assert len(cut) > 20
    by = {}
    for low, high, b, e, own_b, own_e in cut:
        for p, x, y in periodic_runs.solve(w[b:e], low, high, (own_b - b, own_e - b)):
            by.setdefault(p, []).append((x + b, y + b))
    for p, spans in by.items():
        spans = sorted(set(spans))
        end = spans[0][1]
        for x, y in spans:
            assert x <= end
            end = max(end, y)
        by[p] = (spans[0][0], end)
    assert by[1] == (285_000, 334_999) and by[90_000] == (10_000, 195_000)


def test_markup_that_browsers_read_otherwise():
    text = lambda html: site_style.main_text(site_style.parse(html))
    assert text("<p>A</p><script src=/a/b/>var x=1;</script><p>B</p>") == "A\nB"
    assert text("<p>A</p><script src='a'/>var x;</script x><p>B</p>") == "A\nB"
    assert text("<article data-u=http://x/><p>A</p></article><p>B</p>") == "A"
    assert text("<nav data-u=/x/>menu</nav><p>B</p>") == "B"
    assert text("<p>A</p><!--><p>B</p><!---><p>C</p><!-- x --!><p>D</p><!-- y") == "A\nB\nC\nD"
    assert text("<p>A <svg><path d='x'/></svg>B</p><svg/><p>C</p>").replace("A B", "A\nB").split("\n") == ["A", "B", "C"]


def test_names_with_hyphens_name_noise():
    text = lambda html: site_style.main_text(site_style.parse(html))
    noise = ["cookie-banner", "site-footer", "main-nav", "newsletter-signup", "ad-slot", "comments-section", "post-comments", "comment-list", "main_nav"]
    for name in noise:
        assert text(f"<article><p>The words</p><div class='{name}'>noise</div></article>") == "The words", name
        assert text(f"<p>The words are longer</p><div class='{name}'>noise</div>") == "The words are longer", name
    for name in ("has-sidebar", "no-ads", "share-text", "article-body", "lead-in", "nav-content"):
        assert text(f"<article><p class='{name}'>The words</p></article>") == "The words", name
    assert text("<div class='layout-sidebar'><article><p>The words</p></article></div>") == "The words"


def test_a_payload_that_was_changed_raises(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 200), (2, "v", "x" * 200), (3, "w", "y")], "page_id long, url string, html string")
    for change in ("cast('tampered' as binary)", "cast(concat(cast(payload as string), ' ') as binary)"):
        folder = batches.shared_folder(spark, "t")
        archive.write_archive(pages, folder)
        stored = spark.read.parquet(f"{folder}/payloads").selectExpr("payload_digest", f"{change} as payload").collect()
        spark.createDataFrame(stored, "payload_digest binary, payload binary").write.mode("overwrite").parquet(f"{folder}/payloads")
        for column in ("payload", "record"):
            with pytest.raises(Exception, match="digest"):
                archive.rebuild_records(spark, folder).select(column).collect()
        with pytest.raises(Exception, match="digest"):
            archive.read_records(spark, folder).collect()


def test_the_shuffles_of_an_archive_are_released(spark, tmp_path):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        names = disk.getAllFiles()
        return {n for n in (names.apply(i).getName() for i in range(names.size())) if n.startswith("shuffle_") and n.endswith(".data")}

    batches.release(spark)
    time.sleep(1)
    before = shuffles()
    pages = spark.range(2000).selectExpr("id as page_id", "'u' as url", "repeat(cast(id as string), 50) as html")
    archive.write_archive(pages, str(tmp_path / "archive"))
    assert shuffles() - before
    batches.release(spark)
    for _ in range(50):  # they go in a thread of Spark's
        if not shuffles() - before:
            break
        time.sleep(0.1)
    assert not shuffles() - before
