import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from claimloom.llm import bpe_tree, chat, packing, queries, token_shards
from claimloom.llm.tokens import byte_pairs
from claimloom.session import work_dir
from odd import ODD, odd_documents

MULTI, ENGLISH, PATTERN = public_tokenizers.path(queries.MULTI), public_tokenizers.path(queries.ENGLISH), public_tokenizers.PATTERN


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\t\r\x0b\x1c\x85\xa0 　ab'sTreév1中!.\x00😀", max_size=120), st.integers(1, 9))
def test_tree_encoding_equals_plain_encoding(text, leaf):
    pairs = byte_pairs(MULTI, PATTERN)
    ids = bpe_tree.encode_tree(text, pairs, leaf)
    assert ids == pairs.encode(text)
    assert bpe_tree.decode_tree(ids, pairs, leaf) == text.encode()


def test_encode_and_decode_rows(spark):
    rows = bpe_tree.decode(bpe_tree.encode(odd_documents(spark), MULTI, PATTERN, leaf=64), MULTI, PATTERN).collect()
    pairs = byte_pairs(MULTI, PATTERN)
    expected = Counter((i, pairs.packed(t or ""), (t or "").encode()) for i, t, _ in ODD)
    assert Counter((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in rows) == expected
    assert bpe_tree.encode(odd_documents(spark, []), MULTI, PATTERN).count() == 0


def _check_packing(rows, docs):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY
    expected = {}
    for doc_id, text, *_ in docs:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % packing.CAPACITY + 1
        starts = [0, *range(first, len(ids), packing.CAPACITY)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            expected.setdefault(doc_id, []).append((k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in expected.items()}
    return len(sequences)


def test_packing_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.packed(docs, ENGLISH, PATTERN).collect()
    used = _check_packing(rows, docs.select("doc_id", "text").collect())
    assert used <= 1.02 * -(-sum(r["length"] for r in rows) // packing.CAPACITY) + 1


def test_packing_of_odd_documents(spark):
    _check_packing(packing.packed(odd_documents(spark), ENGLISH, PATTERN).collect(), ODD)
    assert packing.packed(odd_documents(spark, []), ENGLISH, PATTERN).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext|", "|>", " ", "  ", "\n", "a", "it's", "é", "1", "中"]), max_size=12).map("".join))
def test_added_tokens_inside_texts(text):
    whole = Tokenizer.from_file(public_tokenizers.path(queries.VOCABULARY))
    pairs = byte_pairs(ENGLISH, PATTERN, public_tokenizers.path(queries.VOCABULARY))
    assert pairs.encode(text) == whole.encode(text, add_special_tokens=False).ids
    assert b"".join(pairs.bytes_of[i] for i in pairs.encode(text)) == text.encode()


def test_packing_of_documents_with_added_tokens(spark, tmp_path):
    """By the query and by the last stage of the pipeline: alone, doubled, glued to words and spaces, over a cut."""
    end = "<|endoftext|>"
    texts = [end, end * 2, f"a {end} b", f"a{end}b", f"  {end}  ", f"\n{end}\n{end}", f"{end[:-1]}", f"word{end} " * 1500, f"{end}'s", end.upper()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    _check_packing(queries.QUERIES["op3_best_fit_packing"](spark, str(tmp_path)).collect(), list(enumerate(texts)))
    _check_packing(corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect(), list(enumerate(texts)))


@pytest.mark.parametrize("seed", range(12))
def test_plan_holds_the_histogram_and_no_more(seed):
    rng = random.Random(seed)
    top = rng.choice([30, 600, 2048])
    histogram = {length: rng.randint(1, rng.choice([3, 5000])) for length in rng.sample(range(1, top + 1), rng.randint(1, min(top, 200)))}
    plan, seen = packing.plan(histogram, 2048, 12), Counter()
    for times, lengths in plan:
        assert times > 0 and sum(lengths) <= 2048
        for length in lengths:
            seen[length] += times
    assert dict(seen) == histogram
    used, bound = sum(t for t, _ in plan), max(-(-sum(k * v for k, v in histogram.items()) // 2048), sum(v for k, v in histogram.items() if k > 1024))
    plain = packing._Plan(2048)
    for length in sorted(histogram, reverse=True):
        plain.best_fit(length, histogram[length])
    assert bound <= used <= 1.02 * sum(t for t, _ in plain.runs.values()) + 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "a<|b\n"]), st.text(alphabet="<|>im_endstar \n", max_size=40)), min_size=1, max_size=25), st.integers(60, 400))
def test_chat_windows_read_back(turns, budget):
    made = list(chat.windows_of(iter(turns), len, budget, budget // 4))
    back, targets = [], []
    for k, (context, tokens, text, loss) in enumerate(made):
        read = chat.read_turns(text)
        assert tokens == len(text)
        assert tokens <= budget or len(read) - context <= 1  # only a single long turn exceeds the budget
        back += read[context if k else 0:]
        targets += [chat.unescape(text[a:b]) for a, b in zip(loss[::2], loss[1::2])]
    assert back == turns
    assert targets == [t for role, t in turns if role == "assistant"]


@pytest.mark.parametrize("size", [100, 512, 513, 700, 900, 1024])
def test_system_turn_in_every_window_that_can_hold_it(size):
    """Of a long system turn every window of small turns has a copy; only turns that leave it no room stand without."""
    said = lambda role, n, mark="x": (role, mark * (n - len(chat.turn_text(role, ""))))
    turns = [said("system", size, "s")] + [said("user" if i % 2 else "assistant", 100 if i != 20 else 900, chr(97 + i % 26)) for i in range(40)]
    made, back = list(chat.windows_of(iter(turns), len, chat.BUDGET, chat.HISTORY)), []
    for k, (context, tokens, text, _) in enumerate(made):
        read = chat.read_turns(text)
        fresh = read[context if k else 0:]
        new = [len(chat.turn_text(*t)) for t in fresh if t != turns[0]]
        assert (read[0] == turns[0]) == (k == 0 or size <= max(chat.BUDGET // 2, chat.BUDGET - new[0]))
        assert tokens <= chat.BUDGET or len(new) == 1
        back += fresh
    assert back == turns


def test_chat_operator_on_odd_rows(spark):
    import hashlib
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", None), (1, 2, "assistant", "x " * 3000), (1, 3, None, ""), (1, 3, None, ""), (None, 0, "assistant", "é<|im_end|>"), (2, None, "assistant", "")]
    rows += [(3, i, "user" if i % 2 else "assistant", f"turn {i} " * 40) for i in range(300)]
    chats = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id bigint, turn bigint, role string, text string, window int, loss int")
    found = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(chats, ENGLISH, PATTERN)).collect()}
    for conv in (1, None, 2, 3):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1] if r[1] is not None else -1)
        said = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert found[conv]["n_turns"] == len(own)
        assert found[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own).encode()).hexdigest()
        assert (found[conv]["loss_chars"], found[conv]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert len(found) == 4
    assert chat.read_back(chat.format_chats(chats.limit(0), ENGLISH, PATTERN)).count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 17, 1000, 4097])
def test_permutation(size):
    numbers = np.arange(size)
    first, second = token_shards.permuted(numbers, size, 1), token_shards.permuted(numbers, size, 2)
    assert sorted(first.tolist()) == list(range(size))
    assert size < 17 or first.tolist() != second.tolist()


def test_training_order_round_trip(spark):
    docs, path = odd_documents(spark).repartition(3), f"{work_dir(spark)}/shards"
    docs.write.parquet(f"{path}-docs")
    docs = spark.read.parquet(f"{path}-docs")
    rows = token_shards.training_order(docs, path, ENGLISH, PATTERN, key=9).collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(ODD)))
    pairs = byte_pairs(ENGLISH, PATTERN)
    crc = lambda t: zlib.crc32(np.array([*pairs.encode(t or ""), token_shards.END_ID], "<u4").tobytes())
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in rows) == Counter((i, crc(t)) for i, t, _ in ODD)
    records = token_shards.read_records(spark, path).orderBy("record").collect()
    assert [r["record"] for r in records] == list(range(len(records)))
    by_shard = {}
    for r in records:
        by_shard.setdefault(r["shard"], []).append(np.frombuffer(bytes(r["ids"]), "<u2"))
    stream = [x for shard in sorted(by_shard) for x in np.concatenate(by_shard[shard]).tolist() if x != token_shards.FILL]
    texts, at = [], 0
    for r in sorted(rows, key=lambda r: r["slot"]):
        texts.append(zlib.crc32(np.array(stream[at:at + r["length"]], "<u4").tobytes()))
        at += r["length"]
    assert at == len(stream) and texts == [r["ids_crc32"] for r in sorted(rows, key=lambda r: r["slot"])]
    half = len(records) // 2
    assert [r["record"] for r in token_shards.read_records(spark, path, half).orderBy("record").collect()] == list(range(half, len(records)))
    assert token_shards.training_order(odd_documents(spark, []), f"{path}-none", ENGLISH, PATTERN).count() == 0
