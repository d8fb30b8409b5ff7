"""Each opN_ query itself, on a small folder of tables, against plain Python or DuckDB."""

import random
import zlib
from array import array
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import pytest

import corpus_pipeline
import larkmill.llm as llm
from larkmill.llm import mixing, near_dedup, order_minhash, pieces, quality_gam, secrets

WORDS = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "r", "st", "l")]


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r, at = random.Random(5), str(tmp_path_factory.mktemp("tables"))
    texts = [prose(r, r.randrange(3, 120)) for _ in range(240)]
    for i in range(0, 60, 3):  # near copies, copies, junk, insults, secrets and a passage of many documents
        texts[i + 1] = texts[i].replace(texts[i].split()[-1], "other")
    texts[100:110] = [texts[99]] * 10
    for i in range(120, 170):
        texts[i] = "### ".join(texts[i].upper().split()) + "!!!!"
    for i in range(170, 210):
        w = texts[i].split()
        texts[i] = " ".join([*w[:2], "stupid", r.choice(("clown", "scum,")), *w[2:]])
    passage = prose(r, 60)
    texts[210:216] = [f"{prose(r, 9)} {passage} {prose(r, 5)}" for _ in range(6)]
    texts[216] = f"{prose(r, 5)} password=hunter2! token = 1b215194d600cf2230f038242a103d25b9f70c56 {prose(r, 4)}"
    texts[217:222] = [None, "", " \t\n", "one", "One"]
    texts[222] = prose(r, 9000)
    rows = [(i, t, "en", None if i % 11 == 0 else f"src{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    marks = [(i, int(not 120 <= i < 170), int(170 <= i < 210)) for i in range(0, 215)]
    spark.createDataFrame([*marks, (None, 1, 0), (3, None, None), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, [(i, t) for i, t in enumerate(texts)]


def run(spark, folder, name):
    rows = llm.queries()[name](spark, folder[0]).collect()
    out = {r.doc_id: r for r in rows}
    assert len(out) == len(rows) == len(folder[1])
    return out


def hexed(data):
    return sha256(data).hexdigest()


def test_op1(spark, folder):
    rows, texts = run(spark, folder, "op1_order_minhash"), [t or "" for _, t in folder[1]]
    for i, t in enumerate(texts):
        half, following = len(t) // 2, texts[(i + 1) % len(texts)]
        edited = t[: len(t) - half] + following[:half]
        assert (rows[i].n_chars, rows[i].edited_sha256) == (len(t), hexed(edited.encode()))
        assert len(rows[i].fingerprint) == 4 * order_minhash.COMPONENTS and 0 <= rows[i].near_edited <= 1
        assert (rows[i].fingerprint == rows[(i + 1) % len(texts)].fingerprint) == (rows[i].near_next == 1)
        # likeness: equal components among those that either fingerprint has
        for one, other, near in ((rows[i].fingerprint, rows[i].edited_fingerprint, rows[i].near_edited), (rows[i].fingerprint, rows[(i + 1) % len(texts)].fingerprint, rows[i].near_next)):
            pairs = [(one[k : k + 4], other[k : k + 4]) for k in range(0, len(one), 4)]
            either = [(a, b) for a, b in pairs if {a, b} != {order_minhash.EMPTY}]
            assert near == pytest.approx(sum(a == b for a, b in either) / len(either) if either else 1.0)


def test_op2(spark, folder):
    rows = run(spark, folder, "op2_suffix_tree")
    for i, t in folder[1]:
        assert rows[i].held_out == (zlib.crc32(str(i).encode()) % 10 == 0)
        assert rows[i].n_tokens == len((t or "").encode().split()) + 1 and rows[i].score >= rows[i].base_score - 3 * rows[i].n_tokens
    assert len({r.train_tokens for r in rows.values()}) == 1


def test_op3(spark, folder):
    rows = run(spark, folder, "op3_media")
    for i, t in folder[1]:
        raw = (t or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
        assert (rows[i].n_bytes, rows[i].payload_bytes, rows[i].payload_sha256, rows[i].tail_crc32) == (len(raw), len(payload), hexed(payload), zlib.crc32(payload[-64:]))
        assert len(rows[i].feature) == 16
    assert len({(r.media_sha256, r.media_bytes, r.feature) for r in (rows[i] for i in range(99, 110))}) == 1


@pytest.mark.parametrize("name, mod, value, toxic", [("op4_quality", 4, 2, False), ("op9_toxicity", 3, 1, True)])
def test_classifiers(spark, folder, name, mod, value, toxic):
    rows = run(spark, folder, name)
    right = []
    for i, _ in folder[1]:
        assert rows[i].held_out == (zlib.crc32(str(i).encode()) % mod == value)
        assert 0 <= rows[i].score <= 1 and rows[i].predicted == int(rows[i].score >= 0.7)
        if rows[i].held_out and i < 215:
            right.append(rows[i].predicted == int(170 <= i < 210 if toxic else not 120 <= i < 170))
    assert sum(right) >= 0.95 * len(right)
    if toxic:
        text = dict(folder[1])
        said = [text[i][slice(*map(int, r.offending.split(",")[0].split("-")))] for i, r in rows.items() if r.offending]
        assert said and all(w.split()[0].strip(",") in ("stupid", "clown", "scum") for w in said)


def test_op5(spark, folder):
    rows, library = run(spark, folder, "op5_sentencepiece"), pieces.load(None)
    for i, t in folder[1]:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == (len(ids), hexed(array("I", ids).tobytes()), hexed(library.decode(ids).encode()))


def test_op6(spark, folder):
    rows, starts, gone = run(spark, folder, "op6_substrings"), defaultdict(list), defaultdict(set)
    split = {i: (t or "").encode().split() for i, t in folder[1]}
    for i, w in split.items():
        for k in range(len(w) - 34):
            starts[tuple(w[k : k + 35])].append((i, k))
    for places in starts.values():
        if len(places) > 1:
            for i, k in places:
                gone[i].update(range(k, k + 35))
    for i, w in split.items():
        assert (rows[i].n_words, rows[i].n_removed, rows[i].kept_sha256) == (len(w), len(gone[i]), hexed(b" ".join(x for k, x in enumerate(w) if k not in gone[i])))
    assert len(gone) > 20


def test_op7(spark, folder):
    rows = run(spark, folder, "op7_mixing")
    sizes, of = Counter(), {i: None if i % 11 == 0 else f"src{i % 4}" for i, _ in folder[1]}
    for i, t in folder[1]:
        assert rows[i].size == len((t or "").encode().split()) and rows[i].taken % max(1, rows[i].size) == 0 and rows[i].taken <= 2 * rows[i].size
        sizes[of[i]] += rows[i].size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(order, mixing.targets([sizes[s] for s in order], [mixing.WEIGHTS[k % 3] for k in range(len(order))], 1.5 * sum(sizes.values())), strict=True))
    taken = Counter()
    for i, r in rows.items():
        assert r.source_size == sizes[of[i]] and r.target == pytest.approx(targets[of[i]])
        taken[of[i]] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 1 for s in order)


def test_op8(spark, folder):
    rows = llm.queries()["op8_secrets"](spark, folder[0]).collect()
    text = dict(folder[1])
    for r in rows:
        assert hexed(text[r.doc_id][r.start : r.start + r.length].encode()) == r.value_sha256
    assert [(r.doc_id, r.nth, r.length) for r in rows if r.secret] == [(216, 0, 8), (216, 1, 40)]


def test_op10(spark, folder):
    rows = run(spark, folder, "op10_near_dedup")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder[0]}/documents.parquet/*.parquet')")
    want = {x[0]: x for x in c.execute(llm.oracle_sql()["op10_near_dedup"]).fetchall()}
    assert {i: (r.doc_id, r.n_shingles, r.component_id, r.kept) for i, r in rows.items()} == want
    assert sum(not r.kept for r in rows.values()) > 20


def test_pipeline_stages(spark, folder):
    at, docs = folder[0], spark.read.parquet(f"{folder[0]}/documents.parquet")
    columns = docs.columns
    good = corpus_pipeline.quality(spark, docs, at).cache()
    model = quality_gam.train(docs, spark.read.parquet(f"{at}/labels.parquet"))
    scores = {r.doc_id: r.score for r in quality_gam.score(docs, model).collect()}
    assert good.columns == columns and sorted(r.doc_id for r in good.collect()) == sorted(i for i, s in scores.items() if s >= 0.5)
    assert {r.doc_id for r in good.collect()} >= set(range(60, 99)) and not {r.doc_id for r in good.collect()} & set(range(122, 168))
    one = corpus_pipeline.near_duplicates(spark, good, at).cache()
    links = near_dedup.link(good, 5)
    assert one.columns == columns and sorted(r.doc_id for r in one.collect()) == sorted({r.component_id for r in links.collect()})
    clean = corpus_pipeline.secret_scan(spark, one, at).cache()
    before, after = {r.doc_id: r.text for r in one.collect()}, {r.doc_id: r.text for r in clean.collect()}
    assert clean.columns == columns and [i for i in before if before[i] != after[i]] == [216]
    assert "hunter2" not in after[216] and "1b215194" not in after[216] and after[216].count("[SECRET]") == 2
    mixed = corpus_pipeline.mixture(spark, clean, at).cache()
    copies = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == columns and copies == Counter({r.doc_id: r.copies for r in mixing.mix(clean).collect() if r.copies})
    ids = corpus_pipeline.token_ids(spark, mixed, at)
    library = pieces.load(None)
    for r in ids.collect():
        assert array("I", bytes(r.ids)).tolist() == library.encode(after[r.doc_id] or "", add_bos=True, add_eos=True) and r.n_tokens == len(r.ids) // 4
    assert ids.count() == sum(copies.values())


def test_clashing_names_and_rows_without_ids(spark):
    one, two = " ".join(WORDS[:60]), " ".join(WORDS[60:130])
    names = "doc_id long, text string, source string, n_chars long, row string, times int, time int, _row int, key int, size int, redacted string, cls int, root int"
    rows = [(i, t, "s", len(t or ""), "a", 1, 2, 3, 4, 5, "b", 6, 7) for i, t in ((None, one), (None, one), (None, None), (1, one), (1, two), (2, two), (3, ""))]
    docs = spark.createDataFrame(rows, names)
    kept = near_dedup.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == 5
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == pytest.approx(1.5 * sum(len((r[1] or "").split()) for r in rows), abs=35)
    assert secrets.redacted(docs, secrets.train(spark)).columns == docs.columns
