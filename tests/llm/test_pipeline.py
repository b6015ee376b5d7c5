"""The whole pipeline against brute force: each stage's rule is applied plainly to what the stage before it should have kept."""

import random
import zlib

import corpus_pipeline
from lectern.llm.tokens import Encoder
from test_near_duplicates import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(rng):
    vocabularies = {x: [x[0] + "".join(rng.choices(letters, k=rng.randint(3, 7))) for _ in range(400)] for x, letters in (("en", "abcdef"), ("fr", "ghijkl"), ("de", "mnopqr"))}
    say = lambda lang, n: rng.choices(vocabularies[lang], k=n)
    passages = {x: say(x, 25) for x in vocabularies}
    items = [(i, " ".join(say(x, 30))) for i, x in enumerate(vocabularies)] + [(8, None), (9, "too few words")]
    rows = []

    def add(words, lang):
        text = words if words is None or isinstance(words, str) else " ".join(words)
        rows.append((len(rows), text, lang, "s", None if text is None else len(text)))

    for k in range(90):
        lang = rng.choice(sorted(vocabularies))
        words = say(lang, rng.randint(120, 220))
        if k % 4 == 0:  # a passage that other documents have
            words[10:10] = passages[lang]
        if k % 7 == 0:  # an item with up to two words changed
            planted = items[list(vocabularies).index(lang)][1].split()
            for _ in range(rng.choice([0, 1, 2])):
                planted[rng.randrange(len(planted))] = "changed"
            words += planted
        for _ in range(rng.choice([1, 1, 2, 4])):  # exact and near copies
            copy = list(words)
            for _ in range(rng.choice([0, 1])):
                copy[rng.randrange(len(copy))] = "edited%d" % rng.randrange(10**6)
            add(copy, lang)
    for text in (None, "", "12 345 -- 6", "  "):
        add(text, None)
    add(passages["en"], "en")  # nothing is left of it
    return rows, items


def without_passages(rows):
    """Words covered by 13 words that also start in a document with a smaller id go."""
    split = {d: t.split() for d, t in rows}
    first = {}
    for d in sorted(split):
        for k in range(len(split[d]) - 12):
            first.setdefault(tuple(split[d][k : k + 13]), d)
    out = []
    for d, t in rows:
        w, gone = split[d], set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < d:
                gone.update(range(k, k + 13))
        if len(gone) < len(w) or not gone:
            out.append((d, " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t))
    return out


def holds(item, text):
    """Whether some part of `text` is within a tenth of the item's words of it."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row) <= len(item) // 10


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows, items = make(random.Random(8))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    identified = [(d, t) for d, t, *_ in rows if any(c.isalpha() for c in t or "")]
    single = {c for _, c, _ in brute(identified)}
    kept = without_passages([r for r in identified if r[0] in single])
    long_items = [x.split() for _, x in items if x and len(x.split()) >= 5]
    clean = dict(r for r in kept if not any(holds(x, r[1].split()) for x in long_items))
    assert len(rows) > len(identified) > len(single) > len(kept) > len(clean) > 0

    pieces, filled = {}, {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(clean)
    code = Encoder("byte_bpe_50k.json")
    for d, text in clean.items():
        ids, at = code.whole(text) + (1).to_bytes(4, "little"), 0
        for p in sorted(pieces[d], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) // 4 and p.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + p.length)])
            at += p.length
        assert at == len(ids) // 4
    for spans in filled.values():
        spans.sort()
        assert all(o == sum(n for _, n in spans[:i]) for i, (o, _) in enumerate(spans)) and sum(n for _, n in spans) <= 2048


def test_stages_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_keep_columns_that_are_named_like_theirs(spark, tmp_path):
    text = " ".join(f"word{k}" for k in range(40))
    rows = [(1, text + " and more", 7, "a", 8, 9), (2, text + " or less of all this here", 7, "a", 8, 9), (2, text + " or less of all this here", 7, "a", 8, 9), (None, text, 7, None, 8, 9), (3, None, 7, "a", 8, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, kept_text string, removed int, __batch int")
    out = corpus_pipeline.drop_repeated_passages(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.kept_text or "", r.removed, r["__batch"]) for r in out) == sorted((d or 0, 7, k or "", 8, 9) for d, _, _, k, _, _ in rows)
    assert {r.text for r in out if r.doc_id == 2} == {"or less of all this here"}
    once = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in once) == [1, 3] and all(r["__batch"] == 9 for r in once)
