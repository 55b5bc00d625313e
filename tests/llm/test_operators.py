"""The training-data operators against plain versions, and in odd cases."""

import random
import zlib
from collections import Counter
from hashlib import sha256

import brute
import numpy as np
import public_tokenizers
import pytest
from compare import rows
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import chat, exact_dedup, line_dedup, mixing, near_dedup, packing, pii, quality, queries, token_files, toxicity
from tessella.llm.common import running_sums

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"word{i % 977} of line\n" * (i % 3 == 0) + f"w{i}" for i in range(9000))
#: Columns besides those that are read, with names that operators use themselves.
SCHEMA = "doc_id long, text string, source string, key string, size long, name string, n long, hash long"


def odd_docs():
    rng = random.Random(3)
    base = " ".join(f"w{rng.randrange(400)}" for _ in range(120))
    near = base.replace(" w1", " v1", 1)
    texts = [
        None, "", "", "\n \t", "one", "one", "ONE", base, base, near, base + " tail", LONG, LONG, "a b c", "a b c d", "A b C d", "x" * 9000, "x" * 8999 + "y", "line that is long enough to count\nother\nline that is long enough to count",
        "Line that is LONG enough to count ", "\tline that is long enough to count", "mail bob@site.example.org or +1 (555) 123-4567 at 10.0.0.256 and 10.0.0.1", "é́ İ ﬁ <|endoftext|> don't \x1c\x85", "4111 1111 1111 1111 and 4111-1111-1111-1112", "the " * 200,
    ]
    return [(i * 3 + 1, t, [None, "a", "b", ""][i % 4], "k", 1, None, 5, None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_docs(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


TEXTS = {r[0]: r[1] for r in odd_docs()}


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, duck, name):
    assert rows(queries.QUERIES[name](spark, SMALL).toPandas()) == rows(duck.execute(queries.ORACLES[name]).df())


def test_running_sums_over_a_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2000, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"), "id", (F.col("id") % 5).alias("v"))
    out = running_sums(df, ["k"], ["id"], before="v").where("k = 'hot'").orderBy("id").collect()
    assert [r["before"] for r in out] == list(np.cumsum([i % 5 for i in range(2000)]) - np.array([i % 5 for i in range(2000)]))


# 1


def test_exact_dedup(docs):
    want = brute.exact(TEXTS)
    for block in (4096, 3):  # many rounds of naming
        found = by_id(exact_dedup.exact_dedup(docs, block=block))
        assert {i: (r["keep_id"], r["group_size"], r["kept"]) for i, r in found.items()} == {i: w[:3] for i, w in want.items()}


def test_exact_dedup_tells_contents_apart_that_share_a_hash(docs):
    same = lambda c: F.char_length(c).cast("long") % 2
    found = exact_dedup.identities(docs, [F.col("doc_id")], block=50, hashed=same).groupBy("round", "name").agg(F.sort_array(F.collect_list("row.doc_id")).alias("g")).collect()
    groups = {}
    for i, t in TEXTS.items():
        groups.setdefault(t or "", []).append(i)
    assert sorted(r["g"] for r in found) == sorted(map(sorted, groups.values()))


def test_exact_dedup_odd_tables(spark, docs, none):
    assert exact_dedup.exact_dedup(none).count() == 0
    assert exact_dedup.drop_copies(docs).columns == docs.columns
    with_null = docs.union(spark.createDataFrame([(None, "one", *[None] * 6)], SCHEMA))
    assert exact_dedup.drop_copies(with_null).where("doc_id is null").count() == 1


# 2


def turns(spark, data):
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string, window int, at int")


def formatted(data):
    out = {}
    for conv, turn, role, text, *_ in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    return out


def test_chat_round_trip(spark):
    rng = random.Random(1)
    odd = ["", None, "\\### Assistant: </turn> ok", "<turn user>\n", "\\l\\s\\", "<<\\<", "a\nb", "é" * 30, " ".join(["word"] * 300)]
    data = [(c, t, rng.choice(["system"] if t == 0 and c % 2 else ["user", "assistant"]), rng.choice(odd), 1, 2) for c in range(12) for t in range(rng.randrange(1, 40))]
    data += [(None, None, None, None, 1, 1), (99, 1, "a>b\n<", "x", 1, 1), (99, 1, "assistant", "x", 1, 1), (99, 1, "assistant", "x", 1, 1)]
    windows = chat.windows(turns(spark, data), budget=120, history=40).cache()
    back, want = by_id(chat.read_back(windows), "conv_id"), formatted(data)
    assert back.keys() == want.keys()
    for conv, own in want.items():
        assert [(t["role"], t["text"]) for t in back[conv]["turns"]] == own
        assert back[conv]["loss_text"] == "".join(x for r, x in own if r == "assistant")
    assert windows.count() > len(want)
    for w in windows.collect():
        assert w["n_context"] < w["text"].count("<turn ")
        assert all(a["end"] <= b["start"] for a, b in zip(w["loss"], w["loss"][1:]))


def test_chat_keeps_budget_and_system_turn(spark):
    data = [(1, 0, "system", "be kind", 0, 0)] + [(1, i, "user" if i % 2 else "assistant", " ".join(["w"] * 20), 0, 0) for i in range(1, 30)]
    for w in chat.windows(turns(spark, data), budget=100, history=30).collect():
        sizes = [len(t.split("\n")[1].split()) + chat.TURN_TOKENS for t in w["text"].split("<turn ")[1:]]
        assert sum(sizes) <= 100 and w["text"].startswith("<turn system>\nbe kind</turn>\n")
    assert chat.windows(turns(spark, [])).count() == 0


# 3 and 4


def ids_of(texts):
    made = Tokenizer.from_file(VOCABULARY).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [np.array([*e.ids, 1], "<u4") for e in made]


def held_packing(found, want):
    for doc, ids in want.items():
        at = 0
        for p in sorted((r for r in found if r["doc_id"] == doc), key=lambda r: r["start"]):
            assert (p["start"], p["doc_tokens"]) == (at, len(ids)) and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    by_sequence = {}
    for r in found:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    return by_sequence


def test_packing(docs, none):
    want = dict(zip(TEXTS, ids_of(TEXTS.values())))
    found = packing.packed_documents(docs, VOCABULARY).collect()
    sequences = held_packing(found, want)
    sizes = [sum(n for _, n in s) for s in sequences.values()]
    assert all(n == packing.WINDOW or n & (n - 1) == 0 for n in sizes)  # nothing is padded
    assert packing.packed_documents(none, VOCABULARY).count() == 0


def test_packed_sequences_hold_the_ids(spark, docs, tmp_path):
    table = packing.tokenize(docs, str(tmp_path / "t"), VOCABULARY, window=64)
    packed = packing.pack(table, 64, most_sent=0)
    want = dict(zip(TEXTS, ids_of(TEXTS.values())))
    spans = {}
    for r in packed.collect():
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["doc_id"], r["start"], r["length"]))
    for s in packing.sequences(table, packed, 64).collect():
        assert s["input_ids"] == [int(x) for _, d, a, n in sorted(spans[s["sequence_id"]]) for x in want[d][a : a + n]]


@given(st.lists(st.integers(0, 60), min_size=33, max_size=33))
@settings(max_examples=30, deadline=None)
def test_repeats_use_no_piece_twice(counts):
    counts = np.array([0, *counts[1:]])
    plan, left = packing.repeats(counts, 32, 5)
    used = np.zeros(33, int)
    for combo, times in plan:
        assert sum(combo) == 32 and times > 0
        for n in combo:
            used[n] += times
    assert (used + left == counts).all() and (left >= 0).all()
    places, seen = packing.Places(plan), set()
    for n in range(1, 33):
        sequence, offset = places.of(np.full(counts[n], n), np.arange(counts[n]))
        assert (sequence < 0).sum() == left[n]
        seen.update((s, o) for s, o in zip(sequence, offset) if s >= 0)
    assert len(seen) == used.sum()


def test_absent_lengths_hide_no_triples():
    counts = np.zeros(33, np.int64)
    counts[[4, 10, 18]], counts[20] = 5, 100  # 4 + 8 + 20 fills a window too, but no piece has length 8
    assert packing.solve(counts, 32, 5) == pytest.approx({(4, 10, 18): 5})
    counts = np.zeros(33, np.int64)
    counts[4], counts[[10, 18]] = 100, 2  # nor has one length 28
    assert (4, 10, 18) in packing.solve(counts, 32, 5)


def test_token_files(spark, docs, none, tmp_path):
    token_files.write(docs, str(tmp_path / "a"), VOCABULARY, shard_ids=500)
    found, at = by_id(token_files.read_back(spark, str(tmp_path / "a"))), 0
    for doc, ids in sorted(zip(TEXTS, ids_of(TEXTS.values()))):
        assert tuple(found[doc])[1:] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    token_files.write(none, str(tmp_path / "b"), VOCABULARY)
    assert token_files.read_back(spark, str(tmp_path / "b")).count() == 0


@given(st.lists(st.lists(st.sampled_from([1, 2, 3, 70000]), max_size=60), min_size=1, max_size=8))
@settings(max_examples=60, deadline=None)
def test_shards_decode(texts):
    ids, bounds = np.array([x for t in texts for x in t], "<u4"), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    symbols, _, rules, first = token_files.compress(ids, bounds, least=2)
    shard = token_files.Shard(token_files.encode_shard(np.arange(len(texts)), ids, bounds))
    assert [shard.ids(k).tolist() for k in range(len(texts))] == texts and (shard.all_ids() == ids).all()
    assert len(symbols) <= len(ids) and (token_files.lengths(rules, first) >= 2).all()


@pytest.mark.parametrize("bits", [token_files.SLOT_BITS, 1])  # with two slots, most pairs collide
def test_no_frequent_pair_is_left(bits, monkeypatch):
    monkeypatch.setattr(token_files, "SLOT_BITS", bits)
    rng = np.random.default_rng(5)
    ids = np.minimum(rng.zipf(1.3, 6000), 300).astype(np.uint32)
    bounds = np.array([0, 0, 2000, 2001, 6000])
    symbols, starts, rules, first = token_files.compress(ids, bounds)
    ends = set(starts.tolist())
    pairs = Counter((a, b) for i, (a, b) in enumerate(zip(symbols.tolist(), symbols[1:].tolist()), 1) if i not in ends)
    assert max(pairs.values()) < token_files.LEAST
    shard = token_files.Shard(token_files.encode_shard(np.arange(4), ids, bounds))
    assert [shard.ids(k).tolist() for k in range(4)] == [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]


# 5


def test_mixing(spark, docs, none):
    found = mixing.mix(docs).collect()
    assert len(found) == len(TEXTS)
    by_source = {}
    for r in found:
        assert r["size"] == len(brute.WORD.findall(TEXTS[r["doc_id"]] or "")) and 0 <= r["taken"] <= 2 * r["size"]
        by_source.setdefault(r["source"], []).append(r)
    for own in by_source.values():
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 0.5 and own[0]["source_size"] == sum(r["size"] for r in own)
    assert mixing.mix(none).count() == 0 and sorted(mixing.mix(docs).collect()) == sorted(found)
    assert mixing.mixed_documents(docs).columns == docs.columns


@given(st.lists(st.integers(0, 50), min_size=1, max_size=7))
@settings(max_examples=8, deadline=None)
def test_targets(spark, sizes):
    names = [None, *"abcdefgh"][: len(sizes)]
    found = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")).collect()}
    order = sorted(names, key=lambda x: (x is None, x or ""))
    weight = {n: mixing.WEIGHTS[i % 3] for i, n in enumerate(order)}
    most = {n: 2.0 * s for n, s in zip(names, sizes)}
    stopped, rest = set(), 1.5 * sum(sizes)
    while True:
        free = [n for n in names if n not in stopped]
        room = rest - sum(most[n] for n in stopped)
        over = [n for n in free if room * weight[n] / sum(weight[f] for f in free) > most[n] + 1e-9]
        if not over:
            break
        stopped.update(over)
    for n in names:
        want = most[n] if n in stopped else room * weight[n] / sum(weight[f] for f in free)
        assert found[n] == pytest.approx(want)


# 6


def test_disguises_are_read(spark):
    text = " ".join(["you are an idiot and a moron", "stupid people say so"] * 50)
    restorer = toxicity.Restorer(toxicity.trigrams(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")))
    assert [restorer.read(w) for w in ("1d1ot", "m0r0n", "stuuuupid", "i.d.i.o.t")] == ["idiot", "moron", "stupid", "idiot"]
    assert restorer.restored("so i d i o t says") == ["idiot"]


@pytest.mark.parametrize(
    ("text", "word"),
    [
        ("so 1 d 1 0 t says", "idiot"), ("s t u p 1 d", "stupid"), ("$ t u p ! d", "stupid"), ("m.0.r.0.n", "moron"), ("i~d~i~o~t", "idiot"), ("1~d~1~0~t", "idiot"), ("_i_d_i_o_t_", "idiot"),
        ("stuupid", "stupid"), ("s t u u p 1 d", "stupid"), ("an a i d i o t", "idiot"), ("y o u 1 d 1 0 t", "idiot"), ("i d i o t !", "idiot"), ("i d i o t 1 2 3", "idiot"),
    ],
)
def test_combined_disguises_are_read(spark, text, word):
    plain = " ".join(["you are an idiot and a moron", "stupid people say so a lot"] * 50)
    restorer = toxicity.Restorer(toxicity.trigrams(spark.createDataFrame([(1, plain)], "doc_id long, text string")))
    assert word in restorer.restored(text)


def test_numbers_and_plain_words_are_not_disguised(spark):
    plain = " ".join(["a good book will sell well", "all happy people agree"] * 50)
    restorer = toxicity.Restorer(toxicity.trigrams(spark.createDataFrame([(1, plain)], "doc_id long, text string")))
    assert restorer.restored("1 2 3, 10.5.3.1 + 4: a good book will sell well") == []


def test_toxicity_held_out(spark):
    rng = random.Random(7)
    clean = lambda: " ".join(f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrs')}" for _ in range(30))
    data, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        data.append((i, clean() + (" grimwort " + rng.choice(["vexlar", "vexmon"]) if toxic else "")))
        labels.append((i, None if i % 37 == 0 else int(toxic)))
    docs = spark.createDataFrame([*data, (1000, None), (1001, ""), (1002, "y0u gr1mw0rt")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    score = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all((score[i] >= 0.5) == (i % 4 == 0) for i in held)
    assert score[1000] == score[1001] < 0.5 < score[1002]
    kept = toxicity.drop_toxic(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert kept.count() == 302


def test_toxicity_without_labels(spark, none):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.scored(docs, model).first()["score"] < 0.5
    assert toxicity.scored(none, toxicity.fit(none, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0


# 7


@given(st.text(alphabet="ab1234567890@.+-() _%é\n", max_size=60))
@settings(max_examples=400, deadline=None)
def test_base_spans(text):
    assert [s for s in pii.spans(text) if s[1] < 4] == brute.base_spans(text)


def test_added_spans():
    text = "see https://a.example/x?y=1. My IBAN: GB82 WEST 1234 5698 7654 32, account 12345678; at 12 High Hill Street, 7 rue de la Paix 75002"
    found = {pii.KINDS[k]: text[a:b] for a, k, b in pii.spans(text) if k >= 4}
    assert found["url"] == "https://a.example/x?y=1" and found["account"] == "12345678"
    assert "GB82 WEST 1234 5698 7654 32" in [text[a:b] for a, k, b in pii.spans(text)]
    assert "12 High Hill Street" in [text[a:b] for a, k, b in pii.spans(text) if k == 6]
    assert pii.masked("x a@b.cc y", pii.spans("x a@b.cc y")) == "x <email> y"


def test_personal_data(docs, none):
    for i, r in by_id(pii.personal_data(docs)).items():
        base = brute.base_spans(TEXTS[i] or "")
        assert r["base_sha256"] == sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
        assert r["n_email"] == sum(k == 0 for _, k, _ in base)
    assert pii.personal_data(none).count() == 0


# 8


def test_line_dedup(docs, none):
    want = brute.line_dedup(TEXTS)
    for sent in (1 << 20, 0):
        found = by_id(line_dedup.dedup_lines(docs, most_sent=sent))
        assert {i: (r["n_lines"], r["n_dropped"], r["kept_text"]) for i, r in found.items()} == want
    assert line_dedup.dedup_lines(none).count() == 0


def test_line_index_is_reversible(spark, docs):
    table = line_dedup.postings(docs)
    state = lambda t: sorted(map(tuple, line_dedup.references(t).collect()))
    more = spark.createDataFrame([(900, "line that is long enough to count"), (901, "another line that nobody else has")], "doc_id long, text string")
    grown = line_dedup.add_documents(table, more)
    assert state(grown) != state(table) and state(line_dedup.add_documents(grown, more)) == state(grown)
    assert state(line_dedup.remove_documents(grown, more)) == state(table)
    frequent = lambda t: line_dedup.references(t).where("n_docs > 2").select("fp")
    before, after = frequent(table), frequent(line_dedup.remove_documents(table, docs.where("doc_id > 40")))
    held = line_dedup.filters(before, 2)
    changed = line_dedup.update_filters(held, after.exceptAll(before), before.exceptAll(after), after, 2)
    assert changed.count() <= 2
    for r in changed.collect():
        own = [k["fp"] for k in after.collect() if (k["fp"] >> 20) % 2 == r["shard"]]
        made = line_dedup.CuckooFilter.read(bytes(r["filter"]))
        assert made.holds(np.array(own, np.int64)).all() and np.count_nonzero(made.table) == len(own)  # nothing of the keys that left
    assert after.count() < before.count()


@given(st.sets(st.integers(0, (1 << 64) - 1), max_size=400), st.data())
@settings(max_examples=20, deadline=None)
def test_cuckoo_filter(keys, data):
    keys = sorted(keys)
    held = line_dedup.CuckooFilter.of(np.array(keys, np.uint64))
    assert held.holds(np.array(keys, np.uint64)).all()
    gone = data.draw(st.sets(st.sampled_from(keys))) if keys else set()
    assert all(held.delete(k) for k in gone)
    assert held.holds(np.array([k for k in keys if k not in gone], np.uint64)).all()
    assert line_dedup.CuckooFilter.read(held.bytes()).bytes() == held.bytes()


# 9


@given(st.lists(st.sampled_from(["a", "b", "é#", "cc", "\n", "  ", "\t", "\x85"]), max_size=80))
@settings(max_examples=200, deadline=None)
def test_quality(parts):
    text = " ".join(parts).replace(" \n ", "\n")
    found = quality.measured([text, "other words", text])
    for k, v in brute.quality(text).items():
        assert found[k][0] == found[k][2] == v


def test_windows_by_content_agree():
    words = np.array([1, 2, 3, 1, 2, 3, 1, 2, 9, 1, 2, 3])
    own = quality.Windows(words, np.array([0, 9, 12]))
    for n in (2, 3):
        assert sorted(zip(*own.repeated(n))) == sorted(zip(*own._by_content(n)))


def test_quality_odd_tables(docs, none):
    found = by_id(quality.repetition(docs))
    assert {i: r["base_failed"] for i, r in found.items()} == {i: brute.quality(t or "")["base_failed"] for i, t in TEXTS.items()}
    assert all(not r["kept"] for r in found.values() if r["base_failed"]) and quality.repetition(none).count() == 0


# 10


def test_near_dedup(docs, none):
    want = brute.near(TEXTS)
    for small, block in ((8, 256), (2, 3)):
        found = by_id(near_dedup.near_duplicates(docs, small=small, block=block))
        assert {i: (r["n_shingles"], r["component_id"]) for i, r in found.items()} == want
        assert all(r["kept"] == (i == r["component_id"]) for i, r in found.items())
    assert near_dedup.near_duplicates(none).count() == 0


def test_near_dedup_of_a_large_group(spark):
    """Copies with many edits: links among them that no pivot sees must be found."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(150)]
    texts = {}
    for i in range(120):
        words = list(base)
        for _ in range(rng.choice([0, 1, 3, 5, 8, 12])):
            words[rng.randrange(150)] = f"e{rng.randrange(9999)}"
        texts[i] = " ".join(words)
    found = by_id(near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), small=4, block=16))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in found.items()} == brute.near(texts)


def test_sketch_agreement_is_near_similarity():
    rng = np.random.default_rng(1)
    both, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (600, 200, 200))
    sets = [np.concatenate([both, a]), np.concatenate([both, b]), both[:1]]
    sketch = near_dedup.sketches(np.concatenate(sets), np.concatenate(([0], np.cumsum([len(s) for s in sets]))), 200)
    assert abs((sketch[0] == sketch[1]).mean() - 0.6) < 0.12
    assert (sketch != np.uint64((1 << 64) - 1)).all()


def test_near_dedup_compares_folds(docs):
    """With digests that nearly all sets share, sets are told apart by content."""
    found = by_id(near_dedup.near_duplicates(docs, salts=(0, 0)))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in found.items()} == brute.near(TEXTS)


def test_near_dedup_rows_grow_with_members(spark):
    """Members of one group of near copies: what is dealt to blocks does not grow with their pairs."""
    rng, dealt = random.Random(3), []
    base = [f"w{i}" for i in range(150)]
    plain = near_dedup._blocks
    for size in (300, 600):
        data = []
        for i in range(size):
            words = list(base)
            for _ in range(rng.choice([1, 2, 3])):
                words[rng.randrange(150)] = f"e{i}"
            data.append((i, " ".join(words)))
        count = [0]

        def counted(*args):
            out = plain(*args).cache()
            count[0] += out.count()
            return out

        near_dedup._blocks = counted
        try:
            near_dedup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).count()
        finally:
            near_dedup._blocks = plain
        dealt.append(count[0])
    assert dealt[1] <= 3 * max(dealt[0], 100)


# Rows that repeat, ids that are null, and columns with the operators' own names


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, mark long, mix string, copy int, _r long, _range int, _copy int, _times int, size long, key string, rep long, gone string, label int"


@pytest.fixture(scope="module")
def repeated(spark):
    near = " ".join(f"w{i}" for i in range(60))
    texts = [(1, "one two three four"), (1, "one two three four"), (1, "other words stand here"), (2, "one two three four"), (3, near), (3, near), (4, near + " more"), (None, "one two three four"), (None, near), (5, None), (5, ""), (6, "x" * 5000), (6, "y" * 5000), (7, "x" * 5000)]
    return spark.createDataFrame([(i, t, "en", ["a", None][k % 2], 3, None, "m", 1, 2, 3, 4, 5, 6, "k", 7, "g", 0) for k, (i, t) in enumerate(texts)], CLASHING).repartition(3)


def kept_texts(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_exact_dedup_of_repeated_rows(repeated):
    found = sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(repeated).collect())
    assert found == sorted([(1, 2, 3, False)] * 2 + [(1, 1, 1, True), (2, 2, 3, True)] + [(3, 3, 2, True)] * 2 + [(4, 4, 1, True)] + [(5, 5, 2, True)] * 2 + [(6, 7, 2, False), (6, 6, 1, True), (7, 7, 2, True)])
    near = " ".join(f"w{i}" for i in range(60))
    left = exact_dedup.drop_copies(repeated)
    assert left.columns == repeated.columns
    want = [(1, "other words stand here"), (2, "one two three four"), (3, near), (4, near + " more"), (None, "one two three four"), (None, near), (6, "y" * 5000), (7, "x" * 5000)]
    got = [(i, t) for i, t in kept_texts(left) if i != 5]
    assert got == sorted(want, key=repr) and left.where("doc_id = 5").count() == 1


def test_near_dedup_of_repeated_rows(repeated):
    found = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(repeated).collect())
    assert found == sorted([(1, 1, 1, True)] * 3 + [(2, 1, 1, False)] + [(3, 57, 3, True)] * 2 + [(4, 58, 3, False)] + [(5, 0, 5, True)] * 2 + [(6, 1, 6, True)] * 2 + [(7, 1, 6, False)])
    left = near_dedup.drop_near_copies(repeated, n=4)
    assert left.columns == repeated.columns
    assert sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 0, 1, 1, 3, 5, 6, 6]


def test_mixing_of_repeated_rows(repeated):
    found = mixing.mix(repeated).collect()
    assert len(found) == 14 and sorted(mixing.mix(repeated).collect(), key=repr) == sorted(found, key=repr)
    times = Counter()
    for r in found:
        times[r["doc_id"], r["source"], r["size"]] += int(r["taken"] / r["size"] + 0.5) if r["size"] else 1
    mixed = mixing.mixed_documents(repeated)
    assert mixed.columns == repeated.columns
    got = Counter((r["doc_id"], r["source"], len(brute.WORD.findall(r["text"] or ""))) for r in mixed.collect())
    assert got == +times


def test_other_operators_keep_repeated_rows(spark, repeated, tmp_path):
    assert pii.personal_data(repeated).count() == quality.repetition(repeated).count() == line_dedup.dedup_lines(repeated).count() == 14
    model = toxicity.fit(repeated, spark.createDataFrame([(1, 1), (1, 0), (3, 0)], "doc_id long, toxic int"))
    assert toxicity.scored(repeated, model).count() == 14
    token_files.write(repeated, str(tmp_path / "t"), VOCABULARY)
    back = token_files.read_back(spark, str(tmp_path / "t")).collect()
    assert len(back) == 14 and sum(r["doc_id"] is None for r in back) == 2
    pieces = packing.packed_documents(repeated, VOCABULARY).collect()
    assert sum(r["length"] for r in pieces) == sum(r["n_tokens"] for r in back)


def test_smallest_id_is_not_null(spark, tmp_path):
    low = -(1 << 63)
    token_files.write(spark.createDataFrame([(low, "a"), (None, "b")], "doc_id long, text string"), str(tmp_path / "t"), VOCABULARY)
    assert [r["doc_id"] for r in token_files.read_back(spark, str(tmp_path / "t")).orderBy("start").collect()] == [None, low]


def test_chat_of_one_long_conversation(spark):
    """Windows do not carry the conversation: many turns of one fit into a small heap."""
    turns = spark.range(6000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.lit("abcd "), 120).alias("text"))
    back = chat.read_back(chat.windows(turns)).select(F.size("turns").alias("n"), F.length("loss_text").alias("loss")).first()
    assert tuple(back) == (6000, 3000 * 600)


def test_chat_query(spark):
    """op2_chat_format itself, with conversation -7, against a plain version of every contract column but the formatted length."""
    data = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    data += [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    found, want = by_id(queries.QUERIES["op2_chat_format"](spark, SMALL), "conv_id"), formatted(data)
    assert found.keys() == want.keys()
    for conv, own in want.items():
        said, learnt, r = "".join(f"{a}\n{b}\n" for a, b in own), "".join(b for a, b in own if a == "assistant"), found[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(own), sha256(said.encode()).hexdigest(), len(learnt), sha256(learnt.encode()).hexdigest())
        assert r["formatted_chars"] >= len(said)


def test_chat_system_turns_are_bounded(spark):
    data = [(1, i, "system", "be kind", 0, 0) for i in range(40)] + [(1, i, "user", " ".join(["w"] * 20), 0, 0) for i in range(40, 60)]
    for w in chat.windows(turns(spark, data), budget=100, history=30, chapter=7).collect():
        assert sum(len(t.split("\n")[1].split()) + chat.TURN_TOKENS for t in w["text"].split("<turn ")[1:]) <= 100
    back = chat.read_back(chat.windows(turns(spark, data), budget=100, history=30, chapter=7)).first()
    assert [t["text"] for t in back["turns"]] == [t for *_, t, _, _ in data]


@given(st.lists(st.text(alphabet=st.sampled_from("abZß éÉ1.,'-\t\n\u00a0\u0301ﬁ漢#<|endoftext|>"), max_size=30), max_size=6))
@settings(max_examples=150, deadline=None)
def test_token_ids_are_those_of_the_library(parts):
    """The word encoder's shortcuts against the tokenizers library on whole texts."""
    import pyarrow as pa

    from tessella.llm.tokens import encoder

    ids, bounds = encoder(VOCABULARY).encode(pa.array(parts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [x[:-1].tolist() for x in ids_of(parts)] if parts else not len(ids)


def test_packing_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    held_packing(queries.QUERIES["op3_packing"](spark, SMALL).collect(), dict(zip(docs, ids_of(docs.values()))))


def test_token_files_query(spark):
    docs, at = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}, 0
    found = by_id(queries.QUERIES["op4_token_files"](spark, SMALL))
    for doc, ids in sorted(zip(docs, ids_of(docs.values()))):
        assert tuple(found[doc])[1:] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(found) == len(docs)


def test_pii_query(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    found = by_id(queries.QUERIES["op7_pii"](spark, SMALL))
    names = ("email", "ip", "card", "phone")
    for doc, text in docs.items():
        base = brute.base_spans(text)
        assert found[doc]["base_sha256"] == sha256(",".join(f"{names[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
        assert set(f"{names[k]}:{a}:{b}" for a, k, b in base) <= set(found[doc]["spans"].split(","))
        assert [found[doc][f"n_{n}"] for n in names] == [sum(k == j for _, k, _ in base) for j in range(4)]
    assert len(found) == len(docs)


def test_toxicity_query(spark):
    """Held-out documents of sf0.01, whose labels have some noise: few are toxic; half of them are found at least, few others flagged."""
    folder = SMALL.replace("0.001", "0.01")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    found = by_id(queries.QUERIES["op6_toxicity"](spark, folder))
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    held = [(labels[i], found[i]["predicted"]) for i in labels if i in found and found[i]["held_out"]]
    toxic, clean = [p for t, p in held if t], [p for t, p in held if not t]
    assert toxic and sum(toxic) >= 0.5 * len(toxic) and sum(clean) <= 0.1 * len(clean)
