"""Operators on texts against the public libraries and plain Python, with awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from strandline.llm import merge_encoding, packing, secrets, token_counts, urls
from strandline.llm.registry import PIECE_MODEL, WORD_MODEL

DOCS = "doc_id long, text string, id string, source string"
ODD = [None, "", " ", "   a", "a b", "a  b\n", "▁x", "x ▁ y", "x▁y", "<s> hi</s>", "\x00a", "é́", "ﬁ １", "日本 🙂🙃", "a\r\nb\t", "\ufeffx", "\xa0z", "a   ", "x" * 60, "ab" * 9000, "日" * 3000, "It's 're <|endoftext|> a<|startoftext|>b <|endoftext", "\x1c a\x1db", "ΣΑΣ İ ǅ", "½ ² ª", " .x", "�", "word " * 9000]


def texts(seed=5, n=250):
    rng = random.Random(seed)
    alphabet = [*" abcdeT.é▁\n<|>日", "th", "ing", " the", "<0x0A>", "  ", "🙂"]
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "clash", None) for k, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[4], (None, "a null id", None, None)], DOCS)


def test_merge_encoding_equals_the_library(spark, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    rows = docs.collect()
    got = {r["doc_id"]: r for r in merge_encoding.digests(docs, PIECE_MODEL).collect()}
    assert len(got) == len({r["doc_id"] for r in rows})
    for r in rows:
        ids = sp.encode(r["text"] or "", add_bos=True, add_eos=True)
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()), r
        assert g["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest(), r
    assert merge_encoding.encode_decode(docs.where("false"), PIECE_MODEL).count() == 0


def test_decode_of_broken_bytes():
    codec = merge_encoding.MergeCodec(PIECE_MODEL)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    for raw in (b"\xff", b"\xe6\x97", b"a\xe6\x97\xa5\xff"):
        ids = [codec.byte_ids[b] for b in raw]
        assert codec.decode(ids) == sp.decode(ids)


def test_token_counts_equal_the_library(spark, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    rows = docs.collect()
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(docs, PIECE_MODEL).collect())
    want = sorted((r["doc_id"] or -1, len((r["text"] or "").encode()), n := len(sp.encode(r["text"] or "")), n > 4096) for r in rows)
    assert got == want
    small = token_counts.PieceCounter(PIECE_MODEL, long=20, chunk=16, overlap=2)
    assert small.texts([t or "" for t in texts(9)]) == [len(sp.encode(t or "")) for t in texts(9)] and small.widened
    whole = Tokenizer.from_file(WORD_MODEL)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, WORD_MODEL).collect()}
    assert got == {r["doc_id"]: len(whole.encode(r["text"] or "", add_special_tokens=False).ids) for r in rows}


def test_packing_holds_every_id_once(spark, docs):
    tokenizer = Tokenizer.from_file(WORD_MODEL)
    rows = [r for r in docs.collect() if r["doc_id"] is not None]
    unique = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    pieces = packing.pack(unique, WORD_MODEL, end=2).collect()
    digests = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in packing.pack_digests(unique, WORD_MODEL, end=2).collect()}
    of = {}
    for p in pieces:
        of.setdefault(p["doc_id"], []).append(p)
    for r in rows:
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        mine = sorted(of[r["doc_id"]], key=lambda p: p["start"])
        assert b"".join(bytes(p["ids"]) for p in mine) == ids and all(p["doc_tokens"] == len(ids) // 4 for p in mine)
        assert all(p["start"] == q["start"] + q["length"] for q, p in zip(mine, mine[1:]))
        assert all(zlib.crc32(bytes(p["ids"])) == digests[p["doc_id"], p["start"]] for p in mine)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append(p)
    groups = {}
    for s in sequences.values():
        s.sort(key=lambda p: p["offset"])
        ends = np.cumsum([0, *(p["length"] for p in s)])
        assert [p["offset"] for p in s] == ends[:-1].tolist() and ends[-1] == s[0]["sequence_length"] <= 4096
        assert ends[-1] & (ends[-1] - 1) == 0  # full, or a power of two: no padding
        groups.setdefault(s[0]["step_group"], []).append(ends[-1])
    assert all(len(set(g)) == 1 and sum(g) <= packing.STEP_TOKENS for g in groups.values())
    assert packing.pack(docs.where("false"), WORD_MODEL, end=2).count() == 0


def spans_by_hand(text):
    out = []
    for k, (pattern, group, least) in enumerate([
        (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        (r"AKIA[A-Z0-9]+", 0, 20),
        (r"[0-9a-f]+", 0, 24),
    ]):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return sorted(out)


def test_secrets_keep_the_base_spans(spark):
    rng = random.Random(3)
    parts = ["password", "PassWd", "secret", "ſecret", "token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "AKIA", "ABC123", "deadbeef", "0123456789abcdef", "é", "x", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 40, "\n", "+/", "secret=token:abcdefgh"]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 40))), "", "") for k in range(400)] + [(900, None, "", ""), (901, "a" * 5 + "0" * 30_000, "", "")]
    df = spark.createDataFrame(rows, DOCS)
    kinds = [r.kind for r in secrets.BASE_RULES]
    for r in secrets.digests(df).join(df, "doc_id").collect():
        want = spans_by_hand(r["text"])
        line = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in want)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest(), r["text"]
        assert [r[f"n_{kind}"] for kind in kinds] == [sum(x[1] == k for x in want) for k in range(3)]
        assert set(line.split(",")) - {""} <= set(r["spans"].split(","))
    clean = secrets.redact_documents(df)
    assert clean.columns == df.columns and clean.count() == len(rows)
    assert not any(spans_by_hand(r["text"]) for r in clean.where("text not like '%[%'").collect())
    assert secrets.scan(df.where("false")).count() == 0


def test_trigram_queries_hold_for_every_match():
    assert secrets.trigram_query("[0-9a-f]{24,}") == secrets.ALL
    assert secrets.trigram_query("ab?c") == secrets.ALL
    index = secrets.TrigramIndex(*[np.frombuffer(b"xAPIkeyxapi_keyxapi key", np.uint8), np.array([0, 8, 16, 23])], *secrets.slots(secrets.RULES))
    assert index.rows_for(secrets.trigram_query("(?i:api_?key)")).tolist() == [0, 1]


def test_urls_by_hand(spark):
    cases = {"https://www.a.example.com/en/78": "example.com/en/7", "http://EXAMPLE.net/de/8?x": "example.net/de/8", "http://x.org/es/1": "org/es/", "http://foo.net/de/1#k": "net/de/", "http://com/en/": "com/en/", "http://xcom/en/": None, "http://net": None, "a": None, "": None, None: None, "x://?a/en/": None}
    df = spark.createDataFrame([(k, u, None) for k, u in enumerate(cases)] + [(0, "https://www.a.example.com/en/78", None)], "page_id long, url string, id string")
    got = {r["page_id"]: r for r in urls.url_filter(spark, df).collect()}
    actions = dict((rule, action) for action, rule in urls.RULES)
    for k, (u, rule) in enumerate(cases.items()):
        assert (got[k]["rule"], got[k]["verdict"]) == (rule, actions.get(rule, "allow")), u
    assert (got[1]["host"], got[1]["path"]) == ("example.net", "/de/8")
    assert urls.url_filter(spark, df.where("false")).count() == 0


def test_equal_digests_of_different_rules_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda raw: 7)
    array = urls.DigestArray(str(tmp_path), urls.write_digests(urls.RULES, str(tmp_path)))
    assert [array.stored(i) if i >= 0 else None for i in array.probe(["org/es/", "none/", "com/en/"])] == ["org/es/", None, "com/en/"]
