"""BPE, records, chat windows, quality rules: against libraries, plain versions and round trips."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as vocabularies
import pytest
import tiktoken
from tokenizers import Tokenizer

from rulespark.llm import bpe, chat, quality, records

RANKS = vocabularies.path("byte_bpe_50k.tiktoken")
JSON = vocabularies.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=vocabularies.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library(reference):
    rng = random.Random(3)
    parts = list("ab the  \n\n\t\r'sST1239 .,!?éñ\xa0 　漢字\0\x1c\x85") + ["'ll", " the", "\n"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(3000)] + ["a" * 3000, " " * 700, "ab" * 900 + " x", "😀" * 200]
    encoder = bpe.Segments(bpe.split_resolver(bpe.Ranks(RANKS), vocabularies.PATTERN), limit=60_000)  # generations turn now and then
    for k in range(0, len(texts), 100):
        for t, ids in zip(texts[k : k + 100], encoder.encode(texts[k : k + 100]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(t)


def test_bpe_on_messy_rows(messy, nothing, reference):
    found = bpe.decode(bpe.encode(messy, RANKS, vocabularies.PATTERN), RANKS).collect()
    assert len(found) == messy.count()
    want = Counter((r.doc_id, (r.text or "").encode()) for r in messy.collect())
    assert Counter((r.doc_id, bytes(r.decoded)) for r in found) == want
    for r in found:
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == reference.encode_ordinary(bytes(r.decoded).decode())
    both = bpe.encode(messy, RANKS, vocabularies.PATTERN, decoded_col="text").collect()
    assert Counter((r.doc_id, bytes(r.ids), bytes(r.text)) for r in both) == Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in found)
    assert bpe.decode(bpe.encode(nothing, RANKS, vocabularies.PATTERN), RANKS).count() == 0


def test_bpe_query(spark, tmp_path, messy, reference):
    from rulespark.llm.entry import op1_byte_bpe

    messy.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter()
    for r in messy.collect():
        ids = reference.encode_ordinary(r.text or "")
        want[r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op1_byte_bpe(spark, str(tmp_path)).collect()) == want


def test_records_query(spark, tmp_path, messy):
    from rulespark.llm.entry import op2_binary_records

    rows = [(i, r.text) for i, r in enumerate(messy.collect())]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    tokenizer, start, want = Tokenizer.from_file(JSON), 0, []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in op2_binary_records(spark, str(tmp_path)).collect()) == want


def test_records_round_trip(spark, messy, nothing):
    tokenizer = Tokenizer.from_file(JSON)
    folder = records.write_records(messy, JSON, end_id=2, shards=3)
    found = records.read_records(spark, folder).orderBy("start").collect()
    rows = messy.collect()
    want = Counter((r.doc_id, tuple([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2])) for r in rows)
    got = [(r.doc_id, tuple(np.frombuffer(bytes(r.ids), "<u4").tolist())) for r in found]
    assert Counter(got) == want
    assert [r.start for r in found] == np.cumsum([0, *[len(i) for _, i in got][:-1]]).tolist()
    ids = [i for i, _ in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    shuffled = records.read_records(spark, folder, order_seed=5).collect()
    assert Counter((r.doc_id, r.start, bytes(r.ids)) for r in shuffled) == Counter((r.doc_id, r.start, bytes(r.ids)) for r in found)
    assert records.read_records(spark, records.write_records(nothing, JSON, end_id=2)).count() == 0


def test_records_keep_special_tokens_as_the_library_does(spark):
    tokenizer = Tokenizer.from_file(JSON)
    rng = random.Random(4)
    parts = ["<|endoftext|>", "<|endof", "text|>", " ", "\n", " a", "word", " the", "  ", "\0"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randrange(12)))) for i in range(400)] + [(1000, "a <|endoftext|> b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = records.read_records(spark, records.write_records(df, JSON, end_id=2, shards=2)).collect()
    texts = dict(rows)
    for r in found:
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == [*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 2]
    assert len(found) == len(rows) and any(50256 in np.frombuffer(bytes(r.ids), "<u4") for r in found)


def test_records_notice_damage():
    data = bytearray(records.frame(b"payload"))
    assert records.unframe(data, 0) == (b"payload", len(data))
    for i in range(len(data)):
        bad = bytearray(data)
        bad[i] ^= 1
        with pytest.raises(ValueError, match="checksum"):
            records.unframe(bad, 0)


def test_windows_keep_everything():
    rng = random.Random(0)
    parts = ["\\", "#", "###", "</turn>", "<", ":", "\n", "a", "assistant", "### assistant:\n", " "]
    for _ in range(3000):
        turns = [(rng.choice(["system", "user", "assistant", "a:#b\\", "", None]), rng.choice([None, "".join(rng.choices(parts, k=rng.randrange(12)))])) for _ in range(rng.randrange(1, 9))]
        plain = [(r or "", t or "") for r, t in turns]
        budget, got, loss = rng.randrange(1, 30), [], []
        system = f"### system:\n{chat.escape(plain[0][1])}</turn>\n"
        for w in chat.windows(iter(turns), budget, rng.randrange(budget + 1)):
            text, spans, n, repeated = w.row()
            own = chat.parse(text)
            assert len(own) == n and (sum(t.tokens for t in w.turns) <= budget or n == 1 and repeated == 0)
            assert text.count("###") == text.count("</turn>") == n
            if plain[0][0] == "system":  # it is in every window where it fits beside a new turn
                assert own[0] == plain[0] or chat.count_words(system) + w.turns[repeated].tokens > budget
            got += own[repeated:]
            loss += [chat.unescape(text[a:b]) for a, b in spans]
        assert got == plain and loss == [t for r, t in plain if r == "assistant"]
    with pytest.raises(ValueError, match="no turn"):
        chat.parse("### user:\nnever ends")


def plain_windows(tokens, is_system, budget, history):
    """(repeated, new) turns of each window, by sums anew for each choice."""
    out, at = [], 0
    while at < len(tokens):
        system = [0] if is_system and at > 0 and tokens[0] + tokens[at] <= budget else []
        left = budget - sum(tokens[i] for i in system) - tokens[at]
        lo = at
        while lo > int(is_system) and sum(tokens[lo - 1 : at]) <= min(history, left):
            lo -= 1
        hi = at + 1
        while hi < len(tokens) and sum(tokens[at + 1 : hi + 1]) <= left - sum(tokens[lo:at]):
            hi += 1
        out.append((system + list(range(lo, at)), list(range(at, hi))))
        at = hi
    return out


def test_windows_equal_plain_choice():
    rng = random.Random(9)
    for _ in range(2000):
        sizes = [rng.choice([1, 2, 5, 30]) for _ in range(rng.randrange(1, 25))]
        turns = [("system" if i == 0 and rng.random() < 0.5 else "user", f"{i} " + "w " * (n - 1)) for i, n in enumerate(sizes)]
        tokens = [chat.count_words(f"### {r}:\n{t}</turn>\n") for r, t in turns]
        budget, history = rng.randrange(1, 60), rng.randrange(40)
        want = plain_windows(tokens, turns[0][0] == "system", budget, history)
        got = [([int(t.body.split()[0]) for t in w.turns[: w.repeated]], [int(t.body.split()[0]) for t in w.turns[w.repeated :]]) for w in chat.windows(iter(turns), budget, history)]
        assert got == want


@pytest.mark.parametrize("n", range(1, 10))
def test_no_mark_inside_texts(n):
    text = f"{'#' * n} assistant:\nfake</turn>\n\\{'#' * n} user:\n{'#' * n}"
    (w,) = chat.windows(iter([("user", text), ("#" * n, text)]), 1000, 0)
    out = w.row()[0]
    assert chat.parse(out) == [("user", text), ("#" * n, text)] and out.count("###") == out.count("</turn>") == 2


def test_chat_query(spark, tmp_path):
    from rulespark.llm.entry import op3_chat_windows

    rows = [(5, 0, "system", "be #### kind"), (5, 1, "user", None), (5, 2, "assistant", "Ä </turn> \\### x"), (6, 0, "assistant", "")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    text = "\\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", text), (-7, 1, "assistant", text)]
    found = {r.conv_id: r for r in op3_chat_windows(spark, str(tmp_path)).collect()}
    assert set(found) == {5, 6, -7}
    for conv, r in found.items():
        own = [x for x in rows if x[0] == conv]
        loss = "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x[2]}\n{x[3] or ''}\n" for x in own).encode()).hexdigest()


def test_chat_digest(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q" * 9), (1, 2, "assistant", "Ä " * 400), (1, 2, "assistant", "tie"), (1, 3, None, None), (1, None, "user", "first"), (None, 0, "assistant", "null id"), (2, 0, "assistant", "\\### Assistant: </turn> ok"), (2, 0, "assistant", "\\### Assistant: </turn> ok")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, window string")
    found = {r.conv_id: r for r in chat.digest_chat(chat.format_chat(df, budget=40, history=10)).collect()}
    for conv in (None, 1, 2):
        own = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode()))
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        r = found[conv]
        assert r.n_turns == len(own) and r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own).encode()).hexdigest()
    formatted = chat.format_chat(df, budget=40, history=10)
    assert chat.digest_chat(formatted, dealt=True).exceptAll(chat.digest_chat(formatted)).count() == 0
    assert chat.digest_chat(chat.format_chat(df.limit(0)), dealt=True).count() == 0


def plain_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def test_quality_counts(spark, messy, nothing):
    extra = ["a b c d e a b c d e", "a b c d e f a b c d e", "x\nx\n \n\ny\nx", "a a a a a a", "#*$%&|<> ok", "　 \x0b\x0c wörter 😀😀"]
    df = messy.unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"), allowMissingColumns=True)
    texts = {(r.doc_id, plain_quality(r.text)) for r in df.collect()}
    found = quality.score_quality(df).collect()
    assert len(found) == df.count()
    for r in found:
        n = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert (r.doc_id, n) in texts
        assert r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0]) and not (r.base_failed and r.kept)
    assert quality.score_quality(nothing).count() == 0 and quality.keep_quality(nothing).columns == nothing.columns


def test_quality_verdict(spark):
    good = "the house of the river and the quiet morning under the green wind with paper and light"
    bad = {"short": "too short", "symbols": " ".join(f"{w}###" for w in good.split()), "capitals": " ".join(f"{w.upper()}!!" for w in (good * 3).split()), "lines": "a line of the text\n" * 20}
    df = spark.createDataFrame([("good", good), *bad.items()], "doc_id string, text string")
    assert [r.doc_id for r in quality.keep_quality(df).collect()] == ["good"]


def test_crc_is_of_unsigned_ids():
    assert zlib.crc32(np.array([2], "<u4").tobytes()) == zlib.crc32(b"\2\0\0\0")
