import hashlib
import json
import os
import random
import zlib
from fractions import Fraction

import pytest

from tracefolio.llm import mpeg_audio as M
from tracefolio.llm import tool_calls as T


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 936, 937, 938, 20_000])
def test_round_trip(n):
    payload = M.pad(os.urandom(n))
    s = M.parse(M.mux(payload, tags={"title": "é"}))
    assert s.payload() == payload and s.frames == s.table_frames and not s.skipped and s.tags["title"] == "é"
    assert s.duration == Fraction(1152 * s.frames, 48000) and len(s.points) == 100


def test_false_headers_in_the_payload():
    payload = M.pad(M.STARTS[14] * 800)
    assert M.parse(M.mux(payload)).payload() == payload


def test_resynchronises_after_damage():
    random.seed(1)
    payload = M.pad(bytes(random.randrange(256) for _ in range(30_000)))
    media = M.mux(payload)
    good = M.parse(media)
    hurt = bytearray(media)
    hurt[good.offsets[5] + 1] ^= 0xFF  # a header
    hurt[good.offsets[9] + 10] ^= 0x55  # side information: the checksum fails
    s = M.parse(bytes(hurt))
    # the frame without a header is gone; the one with a wrong checksum is there and named
    assert s.frames == good.frames - 1 and s.skipped and set(s.offsets) == set(good.offsets) - {good.offsets[5]}
    assert s.bad_checksums == 1 and s.offsets[s.bad[0]] == good.offsets[9] and s.samples == good.samples - 1152
    cut = M.parse(media[: good.offsets[4]] + b"\xff\xfa junk" * 3 + media[good.offsets[4] :])
    assert cut.payload() == payload and cut.skipped == 21 and not cut.bad_checksums


def frames(version, n, kbits_index=4, rate_index=0, mono=False, protected=False, padding=(0,), body=b"", sound=lambda k: b"\x55"):
    """Frames by the format's arithmetic alone, with side information that is not empty."""
    low = version != 3
    kbits = (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)[kbits_index - 1] if low else (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)[kbits_index - 1]
    rate = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}[version][rate_index]
    side = {(False, False): 32, (False, True): 17, (True, False): 17, (True, True): 9}[low, mono]
    out = []
    for k in range(n):
        pad = padding[k % len(padding)]
        size = (72 if low else 144) * kbits * 1000 // rate + pad
        head = bytes([0xFF, 0xE0 | version << 3 | 2 | (not protected), kbits_index << 4 | rate_index << 2 | pad << 1, 0xC0 if mono else 0x40])
        info = bytes((k + j) % 251 for j in range(side))
        crc = M.crc16(head[2:] + info).to_bytes(2, "big") if protected else b""
        rest = size - 4 - len(crc) - side
        out.append(head + crc + info + (body if not k else b"").ljust(rest, sound(k))[:rest])
    return out, rate, 576 if low else 1152


@pytest.mark.parametrize("version,rate_index,mono,protected", [(3, 0, False, False), (3, 2, True, True), (2, 0, False, False), (2, 1, True, True), (0, 0, True, False), (0, 2, False, True)])
def test_streams_of_other_writers(version, rate_index, mono, protected):
    made, rate, samples = frames(version, 12, 5, rate_index, mono, protected, padding=(0, 1, 1))
    raw = b"".join(made)
    s = M.parse(raw)
    assert s.frames == 12 and s.samples == 12 * samples and s.rate == rate and not s.skipped and not s.bad_checksums
    assert s.offsets == [sum(map(len, made[:k])) for k in range(12)] and s.duration == Fraction(12 * samples, rate)
    assert M.seek(s, Fraction(5 * samples, rate)) == s.offsets[5]
    junk = b"\x00\xff\xfb\x00junk\xff"
    s = M.parse(junk + b"".join(made[:6]) + junk + b"".join(made[6:]))
    assert s.frames == 12 and s.skipped == 2 * len(junk) and not s.bad_checksums


def test_wrong_checksums_are_counted_and_not_lost():
    made, rate, _ = frames(3, 10, 5, 1, True, True)
    for k in (3, 7):
        f = bytearray(made[k])
        f[4] ^= 0x10
        made[k] = bytes(f)
    s = M.parse(b"".join(made))
    assert s.frames == 10 and s.bad == [3, 7] and not s.skipped and s.duration == Fraction(11520, rate)


def test_a_vbri_table():
    import struct

    plain, rate, samples = frames(3, 8, 9, 0)
    jumps = [len(plain[k]) for k in range(8)]
    table = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, sum(jumps), 8, 8, 1, 2, 1) + b"".join(struct.pack(">H", j) for j in jumps)
    lead = bytearray(frames(3, 1, 9, 0)[0][0])
    lead[36 : 36 + len(table)] = table
    s = M.parse(bytes(lead) + b"".join(plain))
    assert s.table_frames == s.frames == 8 and s.table_bytes == sum(jumps) and s.points[-1] == sum(jumps) and s.offsets[0] == len(lead)


def test_an_encoders_delay():
    import struct

    plain, rate, _ = frames(3, 8, 9, 0)
    table = b"Info" + struct.pack(">I", 0x0F) + struct.pack(">II", 8, sum(map(len, plain))) + bytes(100) + bytes(4) + b"LAME3.100" + bytes(12) + (576 << 12 | 1000).to_bytes(3, "big")
    s = M.parse(frames(3, 1, 9, 0, body=table)[0][0] + b"".join(plain))
    assert (s.delay, s.padding) == (576, 1000) and s.duration == Fraction(8 * 1152 - 1576, rate) and s.frames == s.table_frames == 8


def test_tags_of_all_kinds():
    import struct

    made = b"".join(frames(3, 5)[0])
    sync = lambda n: bytes(n >> k & 0x7F for k in (21, 14, 7, 0))
    long = "x" * 400
    v3 = b"".join(n + struct.pack(">I", len(b)) + b"\x00\x00" + b for n, b in ((b"TXXX", b"\x00long\x00" + long.encode()), (b"TIT2", b"\x01" + "é名".encode("utf-16")), (b"APIC", bytes(300)), (b"TPE1", b"\x00me")))
    v2 = b"TT2" + (4).to_bytes(3, "big") + b"\x00old"
    v4 = b"TCON" + sync(3) + b"\x00\x00" + b"\x03ab"
    tags = b"ID3\x03\x00\x00" + sync(len(v3)) + v3 + b"ID3\x02\x00\x00" + sync(len(v2)) + v2 + b"ID3\x04\x00\x10" + sync(len(v4)) + v4 + b"3DI" + bytes(7)
    s = M.parse(tags + made)
    assert s.tags == {"long": long, "TIT2": "é名", "TPE1": "me", "TT2": "old", "TCON": "ab"} and s.frames == 5 and s.offsets[0] == len(tags) and not s.skipped
    item = struct.pack("<II", 3, 0) + b"Album\x00one"
    ape = item + b"APETAGEX" + struct.pack("<IIII", 2000, len(item) + 32, 1, 0) + bytes(8)
    v1 = b"TAG" + b"a title".ljust(30, b"\x00") + b"who".ljust(30, b"\x00") + bytes(65)
    s = M.parse(made + ape + v1)
    assert s.tags == {"TIT2": "a title", "TPE1": "who", "Album": "one"} and s.frames == 5 and not s.skipped


def test_feature_against_the_format(spark, sf):
    """Frames, duration and offsets worked out from the payload's length alone."""
    room = 960 - 23
    for r in M.media_column(spark.read.parquet(f"{sf}/documents.parquet")).collect():
        full, rest = divmod(r["payload_bytes"], room)
        sizes = [960] * full + ([next(k for k in (96, 120, 144, 168, 192, 240, 288, 336, 384, 480, 576, 672, 768, 960) if k - 23 >= rest)] if rest else [])
        first = r["media_bytes"] - sum(sizes)
        offsets = [first + sum(sizes[:k]) for k in range(len(sizes))]
        d = Fraction(1152 * len(sizes), 48000)
        kbits = ",".join(map(str, sorted({z // 3 for z in sizes})))
        crc = zlib.crc32(b"".join(o.to_bytes(4, "little") for o in offsets))
        assert r["offsets"] == offsets and r["duration"] == f"{d.numerator}/{d.denominator}"
        assert r["feature"] == f"frames={len(sizes)};samples={1152 * len(sizes)};duration={r['duration']};kbits={kbits};offsets_crc32={crc}"


def test_seek():
    s = M.parse(M.mux(M.pad(b"x" * 50_000)))
    assert M.seek(s, 0) == s.offsets[0] and M.seek(s, Fraction(1152 * 7, 48000)) == s.offsets[7] and M.seek(s, 1e6) == s.offsets[-1]


def test_media_column(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in M.media_column(docs, keep_media=True).collect():
        p = M.pad(texts[r["doc_id"]].encode())
        assert r["payload_bytes"] == len(p) and len(p) % 192 == 0 and r["n_bytes"] == len(texts[r["doc_id"]].encode())
        assert r["payload_sha256"] == hashlib.sha256(p).hexdigest() and r["tail_crc32"] == zlib.crc32(p[-16:])
        assert r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest() and r["media_bytes"] == len(r["media"])


def call(*calls, content=None):
    body = {"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]}
    return json.dumps(body | ({"content": content} if content else {}))


SCHEMAS = {"add": {"a": "integer", "b": "integer", "note?": "string"}, "ping": {}}


def test_links_orders_and_checks(spark):
    rows = [
        (1, 0, "user", "hi"),
        (1, 1, "assistant", call(("x", "add", '{"b": 2, "a": 1}'), ("y", "ping", "{}"), content="let me see")),
        (1, 5, "tool", json.dumps({"tool_call_id": "x", "content": "3"})),
        (1, 2, "tool", json.dumps({"tool_call_id": "y", "content": "pong"})),
        (1, 6, "tool", json.dumps({"tool_call_id": "nobody", "content": "?"})),
        (1, 7, "assistant", call(("x", "add", '{"a": 1}'), ("z", "add", '{"a": "1", "b": 2, "c": 3}'), ("w", "sub", "{}"), ("v", "add", "[1]"))),
        (2, 0, "tool", json.dumps({"tool_call_id": "x", "content": "of another conversation"})),
    ]
    out = T.link(T.messages_to_items(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), SCHEMAS)
    got = out.where("conv_id = 1").orderBy(*T.ORDER).collect()
    assert [(r["kind"], r["call_id"]) for r in got[:6]] == [("message", None), ("message", None), ("call", "x"), ("result", "x"), ("call", "y"), ("result", "y")]
    assert [r["json"] for r in T.transcript(out.where("conv_id = 1")).collect()] == [r["json"] for r in got]
    by = {(r["kind"], r["call_id"], r["turn"]): r for r in got}
    assert by["call", "x", 1]["linked"] and by["call", "x", 1]["errors"] == [] and by["result", "x", 5]["linked"]
    assert by["call", "x", 1]["json"] == '{"arguments":{"a":1,"b":2},"id":"x","name":"add","turn":1,"type":"call"}'
    assert by["call", "x", 7]["duplicate"] and not by["call", "x", 7]["linked"] and by["call", "x", 7]["errors"] == ["missing b"]
    assert by["call", "z", 7]["errors"] == ["a is not integer", "unknown argument"]
    assert by["call", "w", 7]["errors"] == ["unknown tool"] and by["call", "v", 7]["errors"] == ["arguments are not an object"]
    assert not by["result", "nobody", 6]["linked"] and by["result", "nobody", 6]["anchor_turn"] == 6
    assert [r["linked"] for r in out.where("conv_id = 2").collect()] == [False]
    place = {(r["kind"], r["call_id"]): i for i, r in reversed(list(enumerate(got)))}
    assert all(place["call", c] < place["result", c] for c in ("x", "y"))


def test_no_python_on_the_way(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    df = T.link(T.messages_to_items(T.replies_as_calls(c)), T.TOOLS)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    by = {k: n for k, n in df.groupBy("kind").count().collect()}
    users = c.where("role = 'user'").count()
    assert by["call"] == 3 * users and df.where("duplicate").count() > 0 and df.where("size(errors) > 0").count() > 0
    assert df.where("kind = 'result' and linked").count() > 0 and df.where("kind = 'result' and not linked").count() > 0


def test_long_and_tied_messages(spark):
    big = "x" * 300_000
    rows = [(1, 0, "assistant", call(("a", "add", json.dumps({"a": 1, "b": 2, "note": big}))))] * 3 + [(1, 1, "tool", json.dumps({"tool_call_id": "a", "content": big}))] * 2
    got = T.link(T.messages_to_items(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), SCHEMAS).collect()
    assert len(got) == 5 and all(r["linked"] for r in got if r["kind"] == "result")
    assert {len(r["json"]) > 300_000 for r in got} == {True} and all(r["errors"] == [] for r in got)
    assert not any(r["duplicate"] for r in got)  # rows that are equal can't be told apart: each is the first


@pytest.mark.parametrize("session", ["true", "false"])
def test_nulls_stay_in_the_json(spark, session):
    rows = [(1, 0, None, None), (1, 1, "tool", json.dumps({"tool_call_id": "x", "content": None})), (1, 2, "assistant", json.dumps({"content": None, "tool_calls": [{"id": "x", "name": "add", "arguments": '{"a":null}'}]})), (None, None, "user", "hi")]
    before = spark.conf.get("spark.sql.jsonGenerator.ignoreNullFields")
    spark.conf.set("spark.sql.jsonGenerator.ignoreNullFields", session)
    try:
        items = T.messages_to_items(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
        got = sorted(r["json"] for r in T.link(items, {"add": {"a": "integer"}}).collect())
    finally:
        spark.conf.set("spark.sql.jsonGenerator.ignoreNullFields", before)
    assert '{"content":null,"role":null,"turn":0,"type":"message"}' in got and '{"content":"hi","role":"user","turn":null,"type":"message"}' in got
    assert any(x.startswith('{"content":null,"id":"x","turn":1') for x in got) and any('"arguments":{"a":null}' in x for x in got)
