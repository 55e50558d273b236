"""Operators that must take whole texts."""

import zlib

from strandline.llm import language_mixture, passage_quality, secrets


def test_quality_is_fitted_on_all_passages(spark, monkeypatch):
    ids = [k for k in range(40) if zlib.crc32(str(k).encode()) % 4 != 2][:6]
    size = {k: 200 if k == ids[0] else 3 for k in ids}
    docs = spark.createDataFrame([(k, "word " * 102 + "x\n" + "word " * 102 * (n - 1) + "yz" * (n - 1)) for k, n in size.items()], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in ids], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(passage_quality, "fit", lambda x, first, y: seen.append([int(n) for n in __import__("numpy").diff([*first, len(x)])]))
    passage_quality.learn(docs, labels)
    assert seen[-1] == [size[k] for k in ids]
    for most in (9, 205):
        monkeypatch.setattr(passage_quality, "SAMPLE_PASSAGES", most)
        passage_quality.learn(docs, labels)
        assert set(seen[-1]) <= {3, 200} and 0 < len(seen[-1]) < 6


def test_private_keys_go_with_their_body(spark):
    body = "\n".join(["MIIEpAIBAAKCAQEA" + "aB3+/xYz" * 6] * 5 + ["Zm9vYg=="])
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    head = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00112233\n\n"
    texts = {
        f"see {begin}\n{body}\n{end}\nthen go": "see [private_key]\nthen go",
        f"see {begin}\r\n{head}{body}\n{end} end": "see [private_key] end",
        f"see {begin}\n{head}{body}\nand so on": "see [private_key]\nand so on",
        f"see {begin}\n{body}": "see [private_key]",
        f"a {begin}\n{body}\n{end}\nb {begin}\n{body}\n{end}\nc": "a [private_key]\nb [private_key]\nc",
        f"a {begin}\n{body}\n\nno end {begin}\n{body}\n{end}": "a [private_key]\n\nno end [private_key]",
        f"key = '{begin}\\n{body[:64]}\\n{end}'": "key = '[private_key]'",
        f"the line {begin}\nopens a key, and\nprose follows": "the line [private_key]\nopens a key, and\nprose follows",
    }
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in secrets.redact_documents(docs).collect()}
    assert [got[k] for k in range(len(texts))] == list(texts.values())


def test_mixture_of_more_than_four_languages(spark):
    words = {f"l{k}": " ".join(a + b + a for a in s for b in s) for k, s in enumerate(("abcd", "efgh", "ijkl", "mnop", "qrst", "uvwx"))}
    model = language_mixture.learn(spark.createDataFrame([(t, lang) for lang, t in words.items()], "text string, lang string"))
    texts = [" ".join(words[f"l{k}"] for k in range(n)) for n in (1, 3, 5, 6)]
    rows = language_mixture.predict(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    got = {r["doc_id"]: (len(r["mixture"]), round(r["score"], 2)) for r in rows}
    assert got == {0: (1, 1.0), 1: (3, 0.33), 2: (5, 0.2), 3: (6, 0.17)}
