"""Matroska, chat, secrets and mixing against plain Python."""

import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import pytest
from siltstone.llm import chat, matroska, mixing, queries, secrets
from siltstone.llm.common import default_tokenizer

ODD = [(1, None, "x", 9), (2, "", "x", 9), (2, "", "x", 9), (None, "a b\tcé d", None, 9), (4, "wörd " * 50_000, "y", 9), (5, "  \n", "y", 9), (6, "token = abcdef0123456789abcdef0123456789 AKIA" + "Q" * 20, "y", 9)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, source string, media int")


@pytest.fixture(scope="module")
def documents(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_every_lacing_round_trips():
    random.seed(1)
    for n in (192, 960, 1152, 960 * 9, 960 * 130 + 192):
        payload = random.randbytes(n)
        for lacing in ("auto", "none", "xiph", "ebml"):
            for frame in (960, 255, 256):
                media = matroska.mux(payload, lacing if lacing != "auto" or frame == 960 else "ebml", frame)
                parsed = matroska.parse(media)
                assert matroska.track_bytes(media, parsed) == payload and not parsed.error
                assert all(media[place : place + 4] == b"\x1f\x43\xb6\x75" for _, _, place in parsed.cues)
                assert len(parsed.cues) == parsed.clusters


def test_damaged_media_gives_an_error_and_no_crash():
    media = matroska.mux(bytes(range(192)) * 30)
    for n in range(0, len(media), 37):
        assert matroska.parse(media[:n]).error or n in (0, len(media)) or matroska.parse(media[:n]).packets == []
    random.seed(2)
    for _ in range(300):
        broken = bytearray(media)
        broken[random.randrange(len(media))] = random.randrange(256)
        matroska.parse(bytes(broken))


def test_unknown_sizes_are_walked():
    payload = bytes(range(192)) * 10
    media = matroska.mux(payload)
    at = media.index(b"\x18\x53\x80\x67") + 4
    length = 9 - media[at].bit_length()
    unknown = media[:at] + bytes([(1 << 8 - length) | (1 << 8 - length) - 1]) + b"\xff" * (length - 1) + media[at + length :]
    assert matroska.track_bytes(unknown, matroska.parse(unknown)) == payload


def test_op1_against_plain_python(spark, sf, documents):
    rows = queries.op1_matroska(spark, sf).collect()
    assert len(rows) == len(documents)
    for r in rows:
        payload = matroska.padded(documents[r.doc_id].text.encode())
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.n_bytes == len(documents[r.doc_id].text.encode())


def test_op1_odd_rows(spark, odd):
    rows = matroska.media_digest(odd).collect()
    assert len(rows) == len(ODD)
    assert sorted(r.n_bytes for r in rows) == sorted(len((t or "").encode()) for _, t, _, _ in ODD)
    packets = matroska.packet_table(matroska.mux_column(odd), "doc_id").collect()
    assert len({r.payload_sha256 for r in rows if r.n_bytes == 0}) == 1
    assert sum(p.byte_length for p in packets) == sum(r.payload_bytes for r in rows)
    assert matroska.media_digest(odd.limit(0)).count() == 0


def turns_of(spark, sf):
    out = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        out[r.conv_id].append((r.role, r.text or ""))
    out[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    return out


def test_op4_against_plain_python(spark, sf):
    expected = turns_of(spark, sf)
    rows = queries.op4_chat(spark, sf).collect()
    assert {r.conv_id for r in rows} == set(expected)
    for r in rows:
        turns = expected[r.conv_id]
        loss = "".join(t for role, t in turns if role == "assistant")
        said = "".join(f"{role}\n{text}\n" for role, text in turns)
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars == len(chat.render(turns)[0])


NASTY = ["", " ", "\n\n x", "<|end|>", "\\<|", "\\\\", "<\\|", "é́🙂", "[INST]<s></s>", "<<SYS>>", "a" * 3000, "<<|role|>|>", "  z "]


def test_chat_escapes_and_masks_hold_for_odd_texts(spark):
    encode = chat.Encoder(default_tokenizer())
    random.seed(3)
    for _ in range(200):
        turns = [(random.choice(["user", "assistant", "<|text|>"]), "".join(random.choices(NASTY, k=3))) for _ in range(random.randrange(1, 6))]
        formatted, spans = chat.render(turns)
        assert chat.read_back(formatted) == turns
        assert not re.search(r"</?s>|\[/?INST\]", formatted)
        ids, offsets = encode(formatted)
        mask = chat.loss_mask(offsets, spans[[r == "assistant" for r, _ in turns]])
        assert "".join(map(chat.unescape, chat.masked_text(formatted, offsets, mask))) == "".join(t for r, t in turns if r == "assistant")
    rows = spark.createDataFrame([(None, 1, None, None, 0), (None, None, "assistant", "z", 0), (1, 0, "user", "q", 0), (1, 0, "user", "q", 0)], "conv_id long, turn long, role string, text string, ids int")
    out = {r.conv_id: r for r in chat.chat_digest(chat.format_chats(rows, default_tokenizer())).collect()}
    assert (out[None].n_turns, out[None].loss_chars, out[1].n_turns) == (2, 1, 2)
    assert chat.chat_digest(chat.format_chats(rows.limit(0), default_tokenizer())).count() == 0


def plain_spans(text):
    """The base rules as they are written, without shortcuts."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?a:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secret_rules_against_the_written_ones():
    random.seed(4)
    parts = ["token", "TOKEN", "Api_Key", "apikey", "passwd", "ſecret", "toKen", " = ", ":", '"', "'", "  ", "abc12", "deadbeef" * 3, "AKIA", "AKIA" * 6, "é", "\n", "=", "x"]
    for _ in range(4000):
        text = "".join(random.choices(parts, k=random.randrange(1, 14)))
        assert [s for s in secrets.find(text) if s[1] < 3] == plain_spans(text), text


def test_op9_against_plain_python(spark, sf, documents):
    rows = queries.op9_secrets(spark, sf).collect()
    assert len(rows) == len(documents)
    for r in rows:
        spans = plain_spans(documents[r.doc_id].text)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in spans) for k in range(3))
        assert r.base_sha256 == hashlib.sha256(secrets.joined(spans).encode()).hexdigest()


def test_ledger_scans_only_unseen_pairs(spark, odd):
    found, fresh = secrets.ledger_scan(odd)
    assert found.count() == len(ODD)
    ledger = spark.createDataFrame(fresh.collect(), fresh.schema)
    assert ledger.count() == len({t or "" for _, t, _, _ in ODD})
    again, more = secrets.ledger_scan(odd, ledger=ledger)
    assert more.count() == 0
    assert sorted(map(str, again.collect())) == sorted(map(str, found.collect()))
    old = ledger.selectExpr("blob", "'1' rule_version", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    assert secrets.scan_unseen(odd, ledger=old).count() == ledger.count()
    assert secrets.ledger_scan(odd.limit(0))[0].count() == 0


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    out, left, stopped = {}, float(sum(sizes.values())), set()
    while True:
        free = [s for s in order if s not in stopped]
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s] = 3.0 * sizes[s]
            stopped.add(s)
            left -= out[s]


def test_op7_against_plain_python(spark, sf, documents):
    rows = queries.op7_mixing(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        d = documents[r.doc_id]
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", d.text))
        sizes[d.source] += r.size
        taken[d.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    goal = plain_targets(sizes)
    for r in rows:
        assert r.target == pytest.approx(goal[documents[r.doc_id].source])
        assert r.source_size == sizes[documents[r.doc_id].source]
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= max(0.02 * sizes[s], 3 * max(r.size for r in rows if documents[r.doc_id].source == s))
    again = queries.op7_mixing(spark, sf).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_targets_stop_at_three_times_the_source(spark):
    sizes = {"a": 1, "b": 1000, "c": 5, None: 40, "d": 0, "\U0001f642": 7, "￿": 3}
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    assert got == {s: pytest.approx(v) for s, v in plain_targets(sizes).items()}


def test_mixing_odd_rows(spark, odd):
    rows = mixing.sample(odd).collect()
    assert len(rows) == len(ODD)
    assert mixing.sample(odd.limit(0)).count() == 0
    mixed = mixing.mix_documents(odd)
    assert mixed.columns == odd.columns


def test_clashing_columns_and_key_types(spark):
    rows = [(1, "token = abcdef0123456789abcdef0123456789 z", "s", "b", "p", "r", 1, 2), (2, "plain words here", "s", "b", "p", "r", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, hit_blob string, hit_spans string, drawn_row string, drawn_copies int, drawn_copy int")
    cut = secrets.redact(df)
    assert cut.columns == df.columns and {r.doc_id: r.text for r in cut.collect()} == {1: f"{secrets.MARK} z", 2: "plain words here"}
    mixed = mixing.mix_documents(df)
    assert mixed.columns == df.columns and mixed.count() >= 1
    turns = spark.createDataFrame([(7, 0, "user", "q"), (7, 1, "assistant", "a")], "conv_id short, turn int, role string, text string")
    assert [(r.conv_id, r.n_turns, r.loss_chars) for r in chat.chat_digest(chat.format_chats(turns, default_tokenizer())).collect()] == [(7, 2, 1)]


def test_web_tokens_in_one_pass():
    rule = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
    random.seed(11)
    for _ in range(4000):
        text = "".join(random.choices(["eyJ", "eyJabcdefgh", ".", "a" * 8, "abc", " ", "_-9"], k=random.randrange(1, 14)))
        assert list(secrets.web_tokens(text)) == [m.span() for m in rule.finditer(text)]
    began = time.time()
    secrets.find("eyJ" * 3_500_000)
    secrets.find("eyJabcdefgh." * 900_000)
    assert time.time() - began < 30
