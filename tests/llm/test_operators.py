"""The other operators against brute force, on small tables with nulls, empty texts, ties, repeats and clashing columns."""

import gzip
import hashlib
import itertools
import math
import random
import time
import zlib

import numpy as np
import pytest

from lectern.llm import archive, batches, decontamination, fingerprints, language, lengths, packing, site_style, token_files
from lectern.llm.tokens import Encoder

SCHEMA = "doc_id long, text string, start string"


def table(spark, seed=1, n=60):
    rng = random.Random(seed)
    texts = [" ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 9))) for _ in range(rng.choice([0, 1, 5, 80, 900]))) for _ in range(n)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(n, None, "x"), (n + 1, "", "x"), (n + 2, "😀" * 2000, "x"), (n + 3, texts[4], None)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_packing(spark):
    rows, df = table(spark)
    code = Encoder("byte_bpe_50k.json")
    out = packing.pack(df, open_windows=4, with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert zlib.crc32(r.ids) == r.ids_crc32
    for d, t, _ in rows:
        pieces = sorted(by_doc[d], key=lambda r: r.start)
        assert b"".join(bytes(p.ids) for p in pieces) == code.whole(t or "") + (1).to_bytes(4, "little")
        assert [p.start for p in pieces] == [sum(q.length for q in pieces[:i]) for i in range(len(pieces))]
    for spans in by_sequence.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))]
        assert sum(n for _, n in spans) <= 2048
    assert packing.pack(spark.createDataFrame([], SCHEMA)).collect() == []


def test_token_files(spark):
    rows, df = table(spark)
    code = Encoder("word_bpe_49k.json")
    df = df.union(spark.createDataFrame([(None, "no id", ""), (3, "again", "")], SCHEMA))
    manifest = token_files.write_token_files(df, batches.shared_folder(spark, "t"))
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(manifest).collect()), key=lambda r: r[2])
    assert [r[:2] for r in got] == sorted(r[:2] for r in got) and got[0][0] is False
    assert [r[2] for r in got] == [sum(x[3] for x in got[:i]) for i in range(len(got))]
    want = {zlib.crc32(code.whole(t or "") + (2).to_bytes(4, "little")) for _, t, _ in rows}
    assert want <= {r[4] for r in got}
    keys = spark.createDataFrame([(3,), (10,), (999,), (None,), (10,)], "doc_id long")
    found = sorted((r.doc_id, bytes(r.ids)) for r in token_files.lookup(manifest, keys, "doc_id").collect())
    end, texts = (2).to_bytes(4, "little"), {d: t or "" for d, t, _ in rows}
    assert found == sorted([(3, code.whole(texts[3]) + end), (3, code.whole("again") + end), *[(10, code.whole(texts[10]) + end)] * 2])
    assert token_files.read_token_files(token_files.write_token_files(spark.createDataFrame([], SCHEMA), batches.shared_folder(spark, "e"))).collect() == []


def test_minimal_perfect_hash():
    for n in (0, 1, 2, 7, 3000):
        keys = np.arange(n, dtype=np.int64) * 977 - 5
        assert sorted(token_files.MinimalPerfectHash.build(keys).slots(keys).tolist() if n else []) == list(range(n))


def test_lengths(spark):
    values = [0, 0, 3, 5, 5, 2000, 4100]
    out = {r.n_tokens: r for r in lengths.length_table(spark.createDataFrame([(v,) for v in [*values, None]], "n_tokens long")).collect()}
    assert set(out) == set(values)
    for n, r in out.items():
        assert r.truncated_tokens == sum(min(v, n) for v in values) and r.docs_at_least == sum(v >= n for v in values)
        assert r.tokens_at_least == sum(v for v in values if v >= n) and r.quantile == sum(v <= n for v in values) / len(values)
    rows, df = table(spark)
    code = Encoder("byte_bpe_50k.json")
    assert sorted(r.n_tokens for r in lengths.encoded_lengths(df).collect()) == sorted(len(code.whole(t or "")) // 4 for _, t, _ in rows)


def test_answers_for_any_limit(spark):
    values = [0, 0, 3, 5, 5, 2000, 4100]
    histogram = lengths.length_table(spark.createDataFrame([(v,) for v in values], "n_tokens long"))
    got = {(r.question, r.asked): r.answer for r in lengths.answers(histogram, [0, 4, 2048, 9000], [0.0, 0.5, 0.9, 1.0]).collect()}
    for limit in (0, 4, 2048, 9000):
        assert got["truncated_tokens", limit] == sum(min(v, limit) for v in values) and got["docs_at_least", limit] == sum(v >= limit for v in values)
    assert [got["quantile", q] for q in (0.0, 0.5, 0.9, 1.0)] == [0, 5, 4100, 4100]
    none = lengths.answers(lengths.length_table(spark.createDataFrame([], "n_tokens long")), [5], [0.5]).collect()
    assert [r.answer for r in none] == [0, 0, None]


def slow_cuts(data):
    out, low = [], 0
    while low < len(data):
        end = min(len(data), low + fingerprints.MOST)
        for k in range(low + fingerprints.LEAST, end):
            h = sum(int(fingerprints._GEAR[data[k - 1 - i]]) << i for i in range(16)) & 0xFFFFFFFF
            mask = int(fingerprints._STRICT if k < low + fingerprints.USUAL else fingerprints._LOOSE)
            if not h & mask:
                end = k
                break
        out.append(end)
        low = end
    return out


def test_fingerprints(spark):
    rng = random.Random(2)
    texts = ["", "a", "".join(rng.choices("abc é", k=3000)), "x" * 700]
    assert [c.tolist() for c in fingerprints.cuts([t.encode() for t in texts])] == [slow_cuts(t.encode()) for t in texts]
    rows, df = table(spark)
    got = {r.doc_id: r for r in fingerprints.compare_with_next(df).collect()}
    ordered = sorted(rows)
    assert len(got) == len(rows)
    for i, (d, t, _) in enumerate(ordered):
        t, after = t or "", ordered[(i + 1) % len(ordered)][1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + after[:half]
        assert got[d].edited_sha256 == hashlib.sha256(e.encode()).hexdigest() and got[d].n_chars == len(t)
        sets = [fingerprints.chunk_sets([x.encode()])[0] for x in (t, e, after)]
        assert got[d].fingerprint == fingerprints.written(sets[0]) and fingerprints.read(got[d].fingerprint) == sets[0]
        assert got[d].near_edited == fingerprints.containment(*sets[:2]) and got[d].near_next == fingerprints.containment(sets[0], sets[2])
    assert fingerprints.compare_with_next(spark.createDataFrame([], SCHEMA)).collect() == []


def test_least_distance_is_edit_distance():
    rng = random.Random(3)
    for _ in range(300):
        item, text = rng.choices("abc", k=rng.randint(1, 8)), rng.choices("abc", k=rng.randint(0, 12))
        row = [0] * (len(text) + 1)
        for i, a in enumerate(item, 1):
            new = [i]
            for j, b in enumerate(text, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
            row = new
        assert decontamination.least_distance(item, text)[0] == min(row)


def test_decontamination(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", 2)
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefg", k=4)) for _ in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(5, 40)))) for i in range(6)] + [(90, None), (91, "bb bb"), (None, "aa bb aa bb aa bb")]
    docs = []
    for d in range(60):
        words = rng.choices(vocabulary, k=rng.randint(0, 60))
        if d % 3:
            planted = rng.choice(items[:6])[1].split()
            for _ in range(rng.choice([0, 1, 2, 4])):
                planted[rng.randrange(len(planted))] = "zz"
            words[:0] = [w.upper() + "," for w in planted]
        docs.append((d, " ".join(words)))
    docs += [(100, None), (101, ""), (102, "so BB, bb it"), (103, "x aa bb aa bb aa bb"), (103, "x aa bb aa bb aa bb"), (None, "bb bb")]
    split = lambda t: (t or "").lower().replace(",", " ").split()
    want = set()
    for d, t in docs:
        for i, x in [*items[:6], *items[7:]]:
            e = decontamination.least_distance(split(x), split(t))[0]
            if e <= int(0.1 * len(split(x)) + 1e-9):
                want.add((d, i, e))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.n_errors) for r in decontamination.find_contamination(df, bench).collect()} == want and {(102, 91, 0), (103, None, 0), (None, 91, 0)} <= want
    clash = df.selectExpr("doc_id", "text", "1 as item_id", "2 as __text", "3 as n_errors")
    assert decontamination.find_contamination(clash, bench).count() == len(want) + 1  # of the repeated row
    assert {r.doc_id for r in decontamination.drop_contaminated(clash, bench).collect()} == {d for d, _ in docs} - {d for d, i, _ in want if i != 91}
    assert decontamination.find_contamination(df.limit(0), bench).collect() == decontamination.find_contamination(df, bench.limit(0)).collect() == []
    assert decontamination.drop_contaminated(df, bench.limit(0)).count() == len(docs)
    long = spark.createDataFrame([(1, "zz " * 300_000 + items[0][1])], "doc_id long, text string")
    assert [(r.item_id, r.end_word) for r in decontamination.find_contamination(long, bench).collect()] == [(0, 300_000 + len(items[0][1].split()))]


def test_decontamination_beyond_ascii(spark):
    items = [(1, "the cat sat on a mat"), (2, "one two three four five six seven eight nine ten"), (3, "敏捷的棕色狐狸跳过了懒狗"), (4, "où était l'élève ce matin")]
    docs = [(1, "He said: “The cat sat—on\u00a0a mat” and…left"), (2, "«one two three…four five six seven eight» nine, ten’"), (3, "他说敏捷的棕色狐狸跳过了懒狗。"), (4, "“Où était l’élève ce matin”"), (5, "the “cat” sat on two mats 敏捷的棕色")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.n_errors) for r in decontamination.find_contamination(df, bench).collect()} == {(k, k, 0) for k in range(1, 5)}


def test_language(spark):
    texts = {"en": "the cat and the dog of this house with that man", "de": "der hund und die katze nicht für eine haus ist", "fr": "le chat et la chienne dans une maison pour les"}
    rng = random.Random(6)
    sample = [(x, " ".join(rng.choices(t.split(), k=30))) for x, t in texts.items() for _ in range(30)]
    model = language.fit([t for _, t in sample], [x for x, _ in sample], chains=150, rounds=15)
    docs = spark.createDataFrame([(1, texts["en"], 0), (2, texts["de"], 0), (3, None, 0), (4, "12 ...", 0), (5, f"{texts['en']} {texts['fr']} {texts['fr']}", 0)], "doc_id long, text string, score int")
    got = {r.doc_id: r for r in language.identify(docs, model, with_segments=True).collect()}
    assert [got[k].lang_pred for k in range(1, 6)] == ["en", "de", "und", "und", "fr"]
    assert [s.lang for s in got[5].segments] == ["en", "fr"]
    assert {r.doc_id for r in language.keep_identified(docs, model).collect()} == {1, 2, 5}
    none = language.fit([], [])
    assert {r.lang_pred for r in language.identify(docs, none).collect()} == {"und"}


def test_forward_backward_equals_brute_force():
    rng = np.random.default_rng(1)
    score, first, t = rng.normal(size=(400, 3)).astype(np.float32), np.array([0, 1, 1, 230, 400]), rng.normal(size=(3, 3)).astype(np.float32)
    got = language.marginals(score, first, t)
    step = np.exp(t.astype(float))
    for a, b in zip(first[:-1], first[1:], strict=True):
        forward, v = [], np.ones(3)
        for i in range(a, b):
            v = (v @ step) * np.exp(score[i])
            v /= v.sum()
            forward.append(v)
        back = np.ones(3)
        for i in range(b - 1, a - 1, -1):
            p = forward[i - a] * back
            assert np.abs(p / p.sum() - got[i]).max() < 1e-4
            back = step @ (np.exp(score[i]) * back)
            back /= back.sum()


def test_expected_transitions_equal_enumeration():
    rng = np.random.default_rng(2)
    score, t = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3))
    p, pairs = language.expectations(score, t)
    want_p, want = np.zeros((2, 4, 3)), np.zeros((3, 3))
    for c in range(2):
        paths = list(itertools.product(range(3), repeat=4))
        weight = np.array([np.exp(sum(score[c, i, y] for i, y in enumerate(path)) + sum(t[a, b] for a, b in itertools.pairwise(path))) for path in paths])
        for path, w in zip(paths, weight / weight.sum(), strict=True):
            for i, y in enumerate(path):
                want_p[c, i, y] += w
            for a, b in itertools.pairwise(path):
                want[a, b] += w
    assert np.abs(p - want_p).max() < 1e-9 and np.abs(pairs - want).max() < 1e-9


def test_sections_and_batches_change_nothing(monkeypatch):
    """A long text by sections is labelled as at once; a fit by small batches of chains finds the languages too."""
    rng = random.Random(3)
    vocabulary = {x: ["".join(rng.choices(s, k=rng.randint(2, 7))) for _ in range(200)] for x, s in {"en": "aeiouthsnr", "de": "äeiuchsnrz", "fr": "éàeuilqsnt"}.items()}
    sample = [(x, " ".join(rng.choices(v, k=60))) for x, v in vocabulary.items() for _ in range(60)]
    model = language.fit([t for _, t in sample], [x for x, _ in sample])
    long = " ".join(w for _ in range(60) for w in rng.choices(vocabulary[rng.choice(["en", "de", "fr"])], k=rng.randint(1, 90)))
    once = language.label(model, [long], True)
    monkeypatch.setattr(language, "_BATCH_BYTES", 1000)
    parts = language.label(model, [long], True)
    assert once[0] == parts[0] and abs(once[1][0] - parts[1][0]) < 1e-5 and once[2] == parts[2] and len(once[2][0]) > 20
    monkeypatch.setattr(language, "_CELLS", 2000)
    other = language.fit([t for _, t in sample], [x for x, _ in sample])
    texts = [(x, " ".join(rng.choices(v, k=30))) for x, v in vocabulary.items() for _ in range(30)]
    assert [language.label(other, [t])[0][0] for _, t in texts] == [x for x, _ in texts]


def test_held_out_accuracy_and_letters(spark):
    rng = random.Random(9)
    letters = {"en": "aeiouthsnr", "de": "äeiuchsnrz", "fr": "éàeuilqsnt"}
    vocabulary = {x: ["".join(rng.choices(s, k=rng.randint(2, 7))) for _ in range(300)] for x, s in letters.items()}
    rows = [(i, " ".join(rng.choices(vocabulary[x], k=40)), x, i % 4 == 2) for i, x in enumerate(rng.choices(sorted(letters), k=300))]
    rows += [(None, "½ ² Ⅷ", "en", False), (None, rows[0][1], rows[0][2], False), (901, rows[0][1] * 300, rows[0][2], True), (902, None, "en", False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, held boolean")
    model = language.train(df, where="not held", per_language=60, chars=2000)
    got = language.identify(df.withColumn("lang_pred", df.lang), model).collect()
    assert len(got) == len(rows)
    truth = {d: x for d, _, x, held in rows if held}
    found = {r.doc_id: r.lang_pred for r in got}
    assert sum(found[d] == x for d, x in truth.items()) >= 0.97 * len(truth)
    assert sorted(r.lang_pred for r in got if r.doc_id is None) == sorted(["und", rows[0][2]])
    assert language.train(df.limit(0)).languages == []


def test_archive(spark):
    long = "<p>é" + "x" * 200
    pages = [(5, "http://a/", long), (2, None, long), (9, "http://b/\r\nX: y", long), (1, "u", "short"), (3, "u", "short"), (4, "u", None), (None, "u", long)]
    folder = batches.shared_folder(spark, "w")
    archive.write_archive(spark.createDataFrame(pages, "page_id long, url string, html string"), folder)
    got = {r.page_id: r for r in archive.read_records(spark, folder).collect()}
    assert len(got) == 7 and {k: (r.record_type, r.refers_to) for k, r in got.items()} == {5: ("revisit", 2), 2: ("response", None), 9: ("revisit", 2), 1: ("response", None), 3: ("response", None), 4: ("response", None), None: ("revisit", 2)}
    stored = archive.read_payloads(spark, folder)
    assert stored.count() == stored.select("payload_digest").distinct().count() == 3
    assert got[4].payload_bytes == 0 and got[9].payload_digest == hashlib.sha256(long.encode()).hexdigest()
    whole = {r.page_id: r for r in archive.rebuild_records(spark, folder).collect()}
    assert bytes(whole[5].payload) == long.encode() and bytes(whole[2].record).endswith(long.encode() + b"\r\n\r\n") and len(whole) == 7
    files = archive.export_warc(archive.rebuild_records(spark, folder), batches.shared_folder(spark, "warc")).collect()
    records = b"".join(gzip.open(f.path.removeprefix("file:")).read() for f in files)
    assert sum(f.records for f in files) == 7 and sorted(records.split(b"WARC/1.1")[1:]) == sorted(bytes(r.record)[8:] for r in whole.values())
    folder = batches.shared_folder(spark, "empty")
    archive.write_archive(spark.createDataFrame([], "page_id long, url string, html string, payload int"), folder)
    assert archive.rebuild_records(spark, folder).collect() == []
    folder, large = batches.shared_folder(spark, "again"), "x" * 3_000_000
    archive.write_archive(spark.createDataFrame([(1, "u", long), (1, "u", long), (2, "v", large)], "page_id long, url string, html string"), folder)
    assert sorted((r.page_id, r.record_type, len(r.payload)) for r in archive.rebuild_records(spark, folder).collect()) == [(1, "response", len(long.encode()))] * 2 + [(2, "response", len(large))]
    assert archive.read_payloads(spark, folder).count() == 2


def test_main_text(spark):
    shell = "<html><body><div class=box><p>Same words on each page</p></div><div class=t><p>{}</p></div></body></html>"
    pages = [(i, f"http://h.org/{i}", shell.format(f"Own words {i}")) for i in range(8)]
    pages += [(20, "http://x.org/", '<nav><a>m</a></nav><article><h1>T &amp; u</h1><p>One\n two<p>three</article><footer>f</footer>'), (21, None, None), (22, "bad", "<p>a < b</p><script>x"), (23, "http://x.org/b", '<div id="comments">c</div><form>q</form><div>tail')]
    got = {r.page_id: r for r in site_style.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [got[i].text for i in range(8)] == [f"Own words {i}" for i in range(8)]
    assert got[20].text == "T & u\nOne two\nthree" and got[21].text == "" and got[22].text == "a < b" and got[23].text == "tail"
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert site_style.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def main_texts(spark, htmls, host="http://s.org/"):
    pages = [(i, f"{host}{i}", h) for i, h in enumerate(htmls)]
    return {r.page_id: r.text for r in site_style.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}


def test_low_branches_with_own_text_stay(spark):
    menu = "".join(f"<li>Item {k}</li>" for k in range(5))
    got = main_texts(spark, [f"<html><body><div class=box><ul>{menu}</ul></div><div class=t><p>Own words {i}</p></div></body></html>" for i in range(8)])
    assert got == {i: f"Own words {i}" for i in range(8)}
    texts = ["The same page"] * 85 + [f"Own words {i}" for i in range(15)]
    assert main_texts(spark, [f"<body><div><p>{t}</p></div></body>" for t in texts]) == dict(enumerate(texts))


def test_repeated_blocks_inside_articles_go(spark):
    page = "<body><article><p>{}</p><div class=zz>Same notice on each page</div></article></body>"
    assert main_texts(spark, [page.format(f"Own words {i}") for i in range(8)]) == {i: f"Own words {i}" for i in range(8)}
    copies = main_texts(spark, [f"<body><div>{i}</div><article><p>A copied text</p></article></body>" for i in range(9)])
    assert set(copies.values()) == {"A copied text"}


def brute_texts(htmls, prior=3.0, least=0.2):
    """The style tree of one host, by plain dictionaries."""
    pages = {}
    for h in htmls:
        page = site_style.parse(h)
        counted = [b for b in page.blocks if not b[0].noise]
        pages.setdefault(tuple(t for _, t in [b for b in counted if b[0].in_article] or counted), page)
    styles, blocks, above = {}, {}, {}
    for page in pages.values():
        shown = {}
        for e in page.elements:
            if not e.noise:
                above[e.path] = e.above
                shown.setdefault(e.path, []).append(tuple(k for k, _ in itertools.groupby(e.children)))
        for path, style in shown.items():
            styles.setdefault(path, []).append(tuple(style))
        for path, text in {(e.path, t) for e, t in page.blocks if not e.noise}:
            blocks.setdefault(path, {}).setdefault(text, []).append(1)
    low = set()
    sums = {}
    for path, texts in blocks.items():
        base = math.log(len(styles[path]) + prior)
        for p in above[path]:
            n, repeated = sums.get(p, (0, 0.0))
            sums[p] = n + sum(map(len, texts.values())), repeated + sum(len(x) * min(1.0, math.log(len(x)) / base) for x in texts.values())
    for path, (n, repeated) in sums.items():
        base, m = math.log(len(styles[path]) + prior), len(styles[path])
        kinds = [styles[path].count(x) for x in set(styles[path])]
        presentation = (base - sum(k * math.log(k) for k in kinds) / m) / base
        share = 0.9 ** len(kinds)
        if (1 - share) * presentation + share * (1 - repeated / n) < least:
            low.add(path)
    kept = {p for path in sums if path not in low for p in above[path]}
    return [site_style.main_text(site_style.parse(h), frozenset(low - kept)) for h in htmls]


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_style_tree_equals_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(site_style, "BROADCAST_ROWS", broadcast)
    rng = random.Random(12)
    for n in (1, 3, 12, 30):
        htmls = []
        for i in range(n):
            body = "".join(f"<p>{rng.choice(['Own', 'Other', 'Third'])} words {i} {k}</p>" for k in range(rng.randint(1, 3)))
            extra = rng.choice(["<div class=x><p>Same on many</p></div>", "<div class=x><b>Same on many</b><p>too</p></div>", ""])
            shell = rng.choice(["<body><div class=top><p>Site</p><p>Motto</p></div><div class=t>{}</div>{}</body>", "<body><article>{}<div class=note>Same notice</div></article>{}</body>"])
            htmls.append(shell.format(body, extra))
        htmls += htmls[:2]
        assert list(main_texts(spark, htmls).values()) == brute_texts(htmls)
    page = site_style.parse(htmls[0])
    assert site_style.main_text(page, frozenset(e.path for e in page.elements)) == ""


def test_markup_that_is_long_or_broken_off(spark):
    began = time.time()
    quotes = "<p>Text</p><a " + 'x="y" ' * 1000
    for html in (quotes, quotes + "'" * 1001, "<p>Text</p>" + "<a x='" * 20_000, "<p>Text</p>" + '<a ="' * 20_000 + ">"):
        assert site_style.main_text(site_style.parse(html)) == "Text"
    assert site_style.main_text(site_style.parse("<div>" * 50_000 + "Text")) == "Text"
    assert site_style.main_text(site_style.parse("<a b='>' c=\">\" d='>one<br/>two<br>three</a>")) == "one two three"
    assert len(site_style.main_text(site_style.parse("".join(f"<p>Word {k}</p>" for k in range(50_000)))).split("\n")) == 50_000
    assert time.time() - began < 20
    rows = [(1, "http://a/", "<p>One</p>", 1, 2), (1, "http://a/", "<p>One</p>", 1, 2), (None, "http://a/", "<p>Two</p>", 1, 2)]
    out = site_style.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host int, low int")).collect()
    assert sorted((r.page_id or 0, r.text) for r in out) == [(0, "Two"), (1, "One"), (1, "One")]
    for names in ("share-price news", "search-results story"):
        assert site_style.main_text(site_style.parse(f"<article class='{names}'>The words</article>")) == "The words"


def test_names_spare_what_holds_the_text():
    text = lambda html: site_style.main_text(site_style.parse(html))
    for html in ("<div class='content has-sidebar'>{}</div>", "<main class='with-sidebar'>{}</main>", "<article class='post comments-open'>{}</article>", "<form>{}</form>", "<div class=widget><article>{}</article></div>", "<main class=widget>{}</main>"):
        assert text(html.format("<p>The words</p>")) == "The words"
    links = "".join(f"<li><a href=#>Source {k}</a></li>" for k in range(4))
    assert text(f"<article><p>The words</p><ul>{links}</ul></article>") == "The words\n" + "\n".join(f"Source {k}" for k in range(4))
    assert text(f"<div><p>The words</p><ul>{links}</ul></div>") == "The words"
    assert text("<article>Short</article><div class=comments><article class=comment>A longer reply</article></div>") == "Short"
    assert text("<article>The words<form>Send</form><div class='share'>Share</div></article>") == "The words"


@pytest.mark.parametrize("size", [50, 4 << 20])
def test_batches_hold_every_row(spark, monkeypatch, size):
    monkeypatch.setattr(batches, "BATCH_BYTES", size)
    rows, df = table(spark)
    batched, n = batches.in_batches(df, "text", "doc_id")
    assert batched.count() == len(rows) and n >= 1
