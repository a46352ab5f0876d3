import zlib
from collections import Counter

import brute
import numpy as np
import pytest

from foliant.llm import mixing


def test_bits_spell_words_one_way():
    words = [b"ab", b"", b"\xc3\xa9x"]
    bits = mixing.bits_of(words, np.zeros(3, int))
    assert np.packbits(bits.bit.astype(np.uint8)).tobytes() == b"ab  \xc3\xa9x "
    assert np.bincount(bits.word).tolist() == [24, 8, 32]
    other = mixing.bits_of([b"ab"], np.array([1]))
    assert (other.slots != bits.slots[:, :24]).any()


def test_probabilities_of_the_next_bit_add_up():
    words = [b"thing", b"think", b"than", b"thin"] * 8
    bits = mixing.bits_of(words, np.zeros(len(words), int))
    size = mixing.ORDERS << mixing.SLOT_BITS
    counts = np.zeros(2 * size, np.float32)
    np.add.at(counts, (bits.slots + size * bits.bit.astype(np.int64)).reshape(-1), 1)
    slots = mixing.Slots(counts[:size], counts[size:])
    mixer = mixing.Mixer.fresh()
    inputs, gate = slots.inputs(bits, without_own=True)
    before = mixer.log2_of(inputs, gate, bits.bit).sum()
    for _ in range(40):
        mixer = mixer.learn(inputs, gate, bits.bit)
    assert mixer.log2_of(inputs, gate, bits.bit).sum() > before
    both = 2.0 ** mixer.log2_of(inputs, gate, bits.bit) + 2.0 ** mixer.log2_of(inputs, gate, 1 - bits.bit)
    assert both == pytest.approx(np.ones(len(both)))


def check_counts(rows, found):
    texts = {i: brute.folded(t).encode().split() + [b""] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    c = Counter(w for i, t in texts.items() if not held[i] for w in t)
    total, distinct = sum(c.values()), len(c)
    for r in found:
        words = texts[r.doc_id]
        base = sum(np.log10((c[w] + 1) / (total + distinct + 1)) for w in words)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(words), sum(c[w] > 0 for w in words), total)
        assert r.base_score == pytest.approx(base) and r.score < 0


def test_counts_and_scores_of_odd_rows(spark):
    texts = [None, "", " ", "One two", "one TWO", "one TWO", "Çé " * 50, "w" * 5000, "a b c d " * 200]
    rows = [(i, t) for i, t in enumerate(texts * 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS word", "2 AS chunk", "3 AS c0")
    found = mixing.mixing_scores(docs).collect()
    assert len(found) == len(rows)
    check_counts(rows, found)
    assert all((r.bits_per_byte is None) == (not texts[r.doc_id % 9]) for r in found)
    assert mixing.mixing_scores(docs.limit(0)).count() == 0
    held = docs.where("crc32(CAST(doc_id AS STRING)) % 7 = 2")
    assert all(r.n_known == 0 and np.isfinite(r.score) for r in mixing.mixing_scores(held).collect())


def test_held_out_documents_are_told_better_than_by_word_counts(spark, data, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK_TOKENS", 50_000)
    docs = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/documents.parquet")
    found = mixing.mixing_scores(docs, class_col="lang").collect()
    check_counts([(r.doc_id, r.text) for r in docs.collect()], found)
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert np.mean([r.bits_per_byte for r in held]) < 2.4


def test_contexts_do_not_share_counts_however_many_there_are():
    rng = np.random.default_rng(3)
    words = [bytes(w) for w in rng.integers(97, 123, (40_000, 9), dtype=np.uint8)]
    classes = np.zeros(len(words), int)
    bits = mixing.bits_of(words, classes)
    inside = np.repeat(np.tile(np.arange(10) >= mixing.ORDERS, len(words)), 8)  # contexts that lie within the word
    number = bits.slots[-1][inside]
    wanted = {(w[i - 4 : i], (1 << d) | (w[i] >> (8 - d))) for w in (x + b" " for x in words) for i in range(4, 10) for d in range(8)}
    assert len(np.unique(number)) == len(wanted) > 1 << 20


def test_counts_of_bits_come_from_the_bytes_that_followed():
    words = [b"thing", b"think", b"than", b"a", b"", b"\xff\x00\xff"]
    classes = np.array([0, 0, 1, 1, 0, 2])
    bits = mixing.bits_of(words, classes)
    zeros, ones = np.zeros(len(bits.codes)), np.zeros(len(bits.codes))
    for slots in bits.slots:
        np.add.at(zeros, slots, 1 - bits.bit)
        np.add.at(ones, slots, bits.bit)
    spelled, _, contexts = mixing._contexts(words, classes)
    pairs = Counter((int(k), int(b)) for row in contexts for k, b in zip(row, spelled, strict=True))
    pairs[(int(bits.keys.max()) - 1, 5)] = 7  # of a context that is not asked for
    key, byte, n = (np.array(x) for x in zip(*((k, b, n) for (k, b), n in sorted(pairs.items())), strict=True))
    slots = mixing.Slots.of(bits, key, byte, n)
    assert slots.zeros.tolist() == zeros.tolist() and slots.ones.tolist() == ones.tolist()


def plain_scores(texts, held):
    """The bits of every token, one after the other, with counts in dictionaries; weights and rates are given."""
    zeros, ones = Counter(), Counter()

    def told(words):
        before = b"   "
        for w in words:
            spelled = b"   "[len(before) :] + before[-3:] + b" " + w + b" "
            for i in range(4, len(spelled)):
                byte, far = spelled[i], spelled[4:i]
                contexts = [("word", far), *((k, spelled[i - k : i]) for k in range(1, mixing.ORDERS + 1))]
                for d in range(8):
                    yield [(c, (1 << d) | (byte >> (8 - d))) for c in contexts], (byte >> (7 - d)) & 1, d
            before = b"   " + w

    for i, words in texts.items():
        if not held[i]:
            for codes, bit, _ in told(words):
                for c in codes:
                    (ones if bit else zeros)[c] += 1

    def score(words, mixer):
        inputs, gates, bits = [], [], []
        for codes, bit, d in told(words):
            n = [(zeros[c], ones[c]) for c in codes]
            longest = sum(a + b > 0 for a, b in n[1:])
            level = sum(sum(n[0]) > x for x in mixing.SEEN)
            inputs.append([np.log((b + mixing.PRIOR) / (a + mixing.PRIOR)) for a, b in n])
            gates.append((d * (mixing.ORDERS + 1) + longest) * (len(mixing.SEEN) + 1) + level)
            bits.append(bit)
        token = np.repeat(np.arange(len(words)), [8 * (len(w) + 1) for w in words])
        log2 = mixer.log2_of(np.array(inputs, np.float32).T, np.array(gates), np.array(bits, np.float32))
        return np.bincount(token, weights=log2) * np.log(2)

    return score


def test_every_bit_of_every_token_is_predicted(spark, monkeypatch):
    rng = np.random.default_rng(5)
    some = ["the", "then", "thing", "a", "an", "été", "x\x00y", "abcdefgh", "abcdefgi", "of", "\x01\x02"]
    texts = {i: " ".join(rng.choice(some, 30)) + f" new{i}" for i in range(40)} | {40: "", 41: None, 42: "The THE"}
    words = {i: brute.folded(t).encode().split() + [b""] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    mixers, fit = [], mixing._spelling
    monkeypatch.setattr(mixing, "_spelling", lambda mixer: mixers.append(mixer.value) or fit(mixer))
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    found = mixing.mixing_scores(docs).collect()
    score = plain_scores(words, held)
    assert len(found) == len(texts) and any(held.values())
    number = {w: i for i, w in enumerate(sorted({w for t in words.values() for w in t}))}
    counts = np.zeros((len(number), mixing.CLASSES))
    for i, t in words.items():
        np.add.at(counts[:, -1], [number[w] for w in t if not held[i]], 1)
    model = mixing._Model(counts.sum(axis=0), int(counts.sum()), len(number))
    for r in found:
        text = words[r.doc_id]
        (wanted,) = model.scores([np.array([number[w] for w in text])], score(text, mixers[0]), counts)
        assert r.score == pytest.approx(wanted, rel=1e-4)


def test_experts_are_mixed_by_what_they_told():
    counts = np.zeros((3, mixing.CLASSES))
    counts[:, 0], counts[:, 4] = [6, 2, 0], [1, 0, 9]
    by_class = counts.sum(axis=0)
    ids, chances = [np.array([0, 1, 0, 2]), np.array([2])], np.array([0.5, 0.2, 0.1, 0.3, 0.25])
    found = mixing._Model(by_class, 18, 3).scores(ids, np.log(chances), counts)
    prior = (by_class + 1) / (by_class + 1).sum()
    for text, p, score in zip(ids, (chances[:4], chances[4:]), found, strict=True):
        wanted = 0.0
        for of_class, of_text in mixing.EXPERTS:
            for k in range(mixing.CLASSES):
                told = prior[k] / len(mixing.EXPERTS)
                if not by_class[k]:
                    told *= of_class == 0
                for t, w in enumerate(text):
                    again = (text[:t] == w).sum() / max(t, 1)
                    b = of_text if t else 0
                    told *= (1 - of_class - b) * p[t] + of_class * counts[w, k] / max(by_class[k], 1) + b * again
                wanted += told
        assert score == pytest.approx(np.log10(wanted))


def test_words_so_far_are_counted_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_BYTES", 40)
    words = [f"prefix{i % 7}{'ab' * (i % 5)}{i}" for i in range(200)]
    rows = spark.createDataFrame([(bytearray(w.encode()), 1 + i % 3, 0, 0, 0, 0) for i, w in enumerate(sorted(words))], "word binary, c0 bigint, c1 bigint, c2 bigint, c3 bigint, c4 bigint")
    from foliant.catalog.base import ship

    ship(spark)
    blocks = list(in_partition(rows.coalesce(1).toArrow().to_batches(), monkeypatch))
    told = Counter()
    for b in blocks:
        for r in b.to_pylist():
            if r["byte"] is not None:
                told[r["key"], r["byte"]] += r["n"]
    facts = [np.array([1 + i % 3, 0, 0, 0, 0], "<f8").tobytes() for i in range(200)]
    whole = mixing._Pieces.of([w.encode() for w in sorted(words)], facts)
    wanted = {(int(k), int(b)): int(n) for k, b, n in zip(*whole.followed(so_far=True), strict=True)}
    assert told and all(wanted[x] == n for x, n in told.items())
    assert len({r["block"] for b in blocks for r in b.to_pylist()}) > 20


def in_partition(batches, monkeypatch):
    from types import SimpleNamespace

    from pyspark import TaskContext

    monkeypatch.setattr(TaskContext, "get", staticmethod(lambda: SimpleNamespace(partitionId=lambda: 0)))
    return mixing._blocking(iter(batches))


def block_of(names, facts):
    """A block's rows as they are given to training, with the bytes that followed its contexts in these very pieces."""
    import pyarrow as pa

    whole = mixing._Pieces.of(names, facts)
    key, byte, n = (np.concatenate(x) for x in zip(whole.followed(so_far=False), whole.followed(so_far=True, among=whole.shared()), strict=True))
    words = pa.table({"words": [names[::2], names[1::2]], "facts": [facts[::2], facts[1::2]]})
    told = {}
    for k, value in zip(key.tolist(), (n * 256 + byte).tolist(), strict=True):
        told.setdefault(k, []).append(value)
    return words, pa.table({"key": pa.array(told, pa.int64()), "told": pa.array(told.values(), pa.list_(pa.int64()))})


def test_a_block_learns_one_row_of_sums():
    names = sorted({f"some{i % 9}{'xy' * (i % 4)}{i % 5}".encode() for i in range(200)})
    facts = [np.array([i % 3, 1, 0, 0, 0], "<f8").tobytes() for i in range(len(names))]
    told = mixing._training(*block_of(names, facts))
    assert told.num_rows == 1
    (total,) = mixing._summed(iter(told.to_batches() * 3))
    assert total.num_rows == 1 and list(mixing._summed(iter([]))) == []
    one, three = (np.frombuffer(x.column("sums")[0].as_py(), "<f8") for x in (told, total))
    assert one[0] == sum(np.frombuffer(x, "<f8").sum() for x in facts)
    assert three == pytest.approx(3 * one)


def test_bytes_in_equal_contexts_are_predicted_once():
    names = [f"beginning{'ab' * (i % 3)}{i}".encode() for i in range(50)] + [b" \x01xya  ", b" \x01zya  "]
    facts = [np.array([1, 0, 0, 0, 0], "<f8").tobytes()] * len(names)
    pieces = mixing._Pieces.of(names, facts)
    bits, which, word = pieces.bits()
    plain = mixing.bits_of(pieces.words, pieces.before, pieces.places)
    assert len(bits.bit) < len(plain.bit) / 2
    assert np.repeat(word, 8).tolist() == plain.word.tolist()
    assert bits.keys.tolist() == plain.keys.tolist() and bits.codes.tolist() == plain.codes.tolist()
    for one, all_ in ((bits.bit, plain.bit), (bits.place, plain.place), *zip(bits.slots, plain.slots, strict=True)):
        assert one.reshape(-1, 8)[which].reshape(-1).tolist() == all_.tolist()


def test_texts_become_numbers_of_their_chunks_words(monkeypatch):
    from types import SimpleNamespace

    import pyarrow as pa
    import zstandard
    from pyspark import TaskContext

    monkeypatch.setattr(TaskContext, "get", staticmethod(lambda: SimpleNamespace(partitionId=lambda: 3)))
    monkeypatch.setattr(mixing, "SLICE_BYTES", 100)
    monkeypatch.setattr(mixing, "CHUNK_TOKENS", 60)
    rng = np.random.default_rng(9)
    some = ["a", "B", "é", "of", "\t", "\x0b\x0c", "\x1c", "\x85", "　", "\r\n", " ", "long" * 40, "x\x00y"]
    texts = [None, "", " ", *(" ".join(rng.choice(some, rng.integers(0, 30))) + str(rng.choice(some)) for _ in range(60)), "a b " * 100]
    table = pa.table({"doc_id": range(len(texts)), "held_out": [i % 4 == 0 for i in range(len(texts))], "class": [i % 5 for i in range(len(texts))], "text": texts})
    rows = [r for b in mixing._coding(iter(table.slice(1).to_batches(max_chunksize=17) + table.slice(0, 1).to_batches())) for r in b.to_pylist()]
    chunks = {}
    for r in rows:
        if r["word"] is not None:
            chunks.setdefault(r["chunk"], {})[r["number"]] = r
    assert len(chunks) > 5 and min(chunks) == 3 << 32
    told, seen = {}, Counter()
    for r in rows:
        if r["word"] is None:
            planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["ids"]), np.uint8)
            told[r["doc_id"]] = [chunks[r["chunk"]][i]["word"] for i in planes.reshape(4, -1).T.copy().view("<i4").reshape(-1)]
            assert r["n_bytes"] == len((texts[r["doc_id"]] or "").encode())
            if not r["held_out"]:
                seen.update((r["chunk"], w, r["doc_id"] % 5) for w in told[r["doc_id"]])
    assert told == {i: brute.folded(t).encode().split() + [b""] for i, t in enumerate(texts)}
    for chunk, pieces in chunks.items():
        for r in pieces.values():
            if not r["word"].startswith(b" "):
                assert [r[f"c{k}"] for k in range(5)] == [seen[chunk, r["word"], k] for k in range(5)]


def test_facts_come_back_packed_by_chunk(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(mixing, "PACKED_ROWS", 7)
    rng = np.random.default_rng(4)
    words = [b"", b"a", b"ab", b"abc", b"\xc3\xa9t\xc3\xa9", b" \x00   a", b"abcdefgh"]
    rows = [(c, i, w, rng.random(6).astype("<f4")) for c in range(3) for i, w in enumerate(words)]
    rng.shuffle(rows)
    table = pa.table([pa.array(x, t) for x, t in zip(zip(*((c, i, w, f.tobytes()) for c, i, w, f in rows), strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["of", "number", "word", "facts"])
    packed = pa.Table.from_batches(mixing._packing(iter(table.to_batches(max_chunksize=4)))).to_pylist()
    assert 3 < len(packed) < len(rows)
    for c in range(3):
        ends, facts = mixing._unpacked([r["pieces"] for r in packed if r["of"] == c])
        assert facts.T.tolist() == [f.tolist() for _, _, _, f in sorted((r for r in rows if r[0] == c), key=lambda r: r[1])]
        assert ends.tolist() == [int.from_bytes((b"   " + w)[-3:] + (w + b"   ")[:3], "big") for w in words]


def test_links_are_numbered_alike_with_and_without_a_table(monkeypatch):
    import pyarrow as pa

    words = [b"", b"a", b"the", b"\xff\xfe\xfd\xfc", b"thing", b"x\x00"]
    texts = [[1, 2, 4, 2, 0], [0], [3, 5, 3, 0], [4, 4, 0]]
    cat = np.concatenate(texts).astype(np.int32)
    ends = mixing._ends(pa.array(words, pa.large_binary()))
    wanted = []
    for text in texts:
        before = b"   "
        for w in (words[i] for i in text):
            wanted.append([bytes([p]) + before[p:] + (w + b"   ")[: p + 1] for p in range(3)])
            before = (b"   " + w)[-3:]
    keys, which = mixing._links(cat, ends)
    assert [[int(k).to_bytes(5, "big") for k in keys[of]] for of in which.T] == wanted
    assert keys.tolist() == sorted({int.from_bytes(x, "big") for row in wanted for x in row})
    monkeypatch.setattr(mixing, "DENSE", 1)
    other = mixing._links(cat, ends)
    assert (other[0] == keys).all() and (other[1] == which).all()


def test_earlier_tokens_and_tiny_chances():
    rng = np.random.default_rng(7)
    cat, text = rng.integers(0, 9, 400).astype(np.int32), np.sort(rng.integers(0, 5, 400))
    begin = np.searchsorted(text, np.arange(5))
    at = np.arange(400) - begin[text]
    wanted = [sum(cat[begin[t] : i] == cat[i]) for i, t in enumerate(text)]
    assert mixing._before(cat, text, at, begin).tolist() == wanted
    assert mixing._before(cat, text << 60, at, begin).tolist() == wanted  # numbers too large to be put into one
    counts = np.zeros((2, mixing.CLASSES))
    counts[0, 0] = 5
    (score,) = mixing._Model(counts.sum(axis=0), 5, 1).scores([np.array([1])], np.array([-3000.0]), counts)
    # The word is new: each expert takes the rest of what it counts its class for.
    shares = (counts.sum(axis=0) + 1) / (counts.sum(axis=0) + 1).sum()
    mean = np.mean([1.0 if not a else shares[0] * (1 - a) for a, _ in mixing.EXPERTS])
    assert score == pytest.approx((-3000 + np.log(mean)) / np.log(10))
