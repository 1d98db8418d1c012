"""Token files, packing, BPE, chat formatting, nearest neighbours and revisits: round trips, plain restatements, edge cases."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from plumbline.llm import ann, bpe, chat, packing, revisit, token_files, tokens

CLASH = "doc_id bigint, text string, part string, row string, ids string, length string, leaf string, segment string"
WORD, BYTE = tokens.vocabulary("word_bpe_49k.json"), tokens.vocabulary("byte_bpe_50k.json")
ODD = ["a", "the", " ", "  ", "\n", "\t", "'s", "'", "ll", "9", "42", ".", "!!", "é", "中", "文字", "😀", "\u00a0", "\x1c", "<|endoftext|>", "<|endof", " x", "I'm", "\r\n",
       "Ab", "İ", "Σ", "ΑΣ", "É", "Ça", "ǅ", "word", "Word", "été", "\u0301", "e\u0301", "ß", ","]


def odd_texts(seed, count, most=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, most))) for _ in range(count)]


def rows_of(seed=1):
    texts = odd_texts(seed, 40) + [None, "", " ", "long word " * 3000, "x" * 9000, "same", "same"]
    return list(enumerate(texts)) + [(None, "no id")]


def frame(spark, rows):
    return spark.createDataFrame([(k, t, *["x"] * 6) for k, t in rows], CLASH)


def library(path, text):
    return tokens.encoder(path).tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_pieces_give_the_library_ids(path):
    for text in odd_texts(2, 1500) + ["", "A.b", "a\nb", "a \n b", "x,\n\ny."]:
        assert np.frombuffer(tokens.encoder(path).encode(text), "<u4").tolist() == library(path, text), repr(text)


def test_tree_concatenation_is_exact():
    rng = random.Random(5)
    for n in range(600):
        some = rng.sample(ODD, rng.choice([1, 2, 3, len(ODD)]))
        text = "".join(rng.choice(some) for _ in range(rng.randint(0, 150))) if n % 4 else "".join(rng.choice("abcdefghij") for _ in range(400))
        parts = [(t.encode(), np.frombuffer(tokens.encoder(BYTE).encode(t), "<u4"), hard) for t, hard in bpe.leaves(text, tokens.encoder(BYTE).special, rng.choice([3, 7, 20, 50]))]
        ids = bpe.concatenate(BYTE, parts)
        assert ids.tolist() == library(BYTE, text), repr(text)
        assert bpe.decode(BYTE, ids) == tokens.encoder(BYTE).tokenizer.decode(ids.tolist(), skip_special_tokens=False)


def test_bpe_round_trip(spark):
    rows = rows_of()
    for leaf in (bpe.LEAF, 50):  # the small leaf sends nearly all texts through the tree
        encoded = bpe.encode(frame(spark, rows), BYTE, leaf=leaf)
        got = sorted((str(r["doc_id"]), r["text"], np.frombuffer(r["ids"], "<u4").tolist()) for r in bpe.decoded(encoded, BYTE).collect())
        assert got == sorted((str(k), t or "", library(BYTE, t)) for k, t in rows)
        said = {(str(r["doc_id"]), r["n_tokens"], r["decoded_sha256"]) for r in bpe.digests(encoded, BYTE).collect()}
        assert said == {(str(k), len(library(BYTE, t)), hashlib.sha256((t or "").encode()).hexdigest()) for k, t in rows}
    assert bpe.digests(bpe.encode(frame(spark, []), BYTE), BYTE).count() == 0


def test_packing_places_every_id_once(spark):
    rows = rows_of()
    got = packing.pack(frame(spark, rows), WORD, 1, window=256, keep_ids=True)
    pieces, placed = defaultdict(list), defaultdict(list)
    for r in got.collect():
        pieces[r["doc_id"]].append(r)
        placed[r["sequence_id"]].append(r)
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and r["length"] == len(r["ids"]) // 4
    for k, t in rows:
        want = [*library(WORD, t), 1]
        assert b"".join(r["ids"] for r in sorted(pieces[k], key=lambda r: r["start"])) == np.array(want, "<u4").tobytes()
        assert {r["doc_tokens"] for r in pieces[k]} == {len(want)}
    for parts in placed.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    assert sorted(placed) == list(range(len(placed)))
    rows_back = packing.sequences(got, 0, 256).collect()
    assert len(rows_back) == len(placed) and all(len(r["ids"]) == 256 for r in rows_back)
    assert packing.pack(frame(spark, []), WORD, 1).count() == 0


def test_placement_pads_little():
    rng = np.random.default_rng(1)
    for lengths in (rng.integers(1, 2049, 100_000), np.full(3000, 3), np.array([2048]), np.full(99, 1024), rng.geometric(0.002, 5000).clip(1, 2048)):
        placement = packing.Placement(np.bincount(lengths, minlength=2049))
        order = np.argsort(lengths, kind="stable")
        number = np.empty(len(lengths), np.int64)
        number[order] = np.arange(len(lengths)) - np.searchsorted(lengths[order], lengths[order])
        sequence, slot = placement.find(lengths, number)
        assert len(set(zip(sequence.tolist(), slot.tolist()))) == len(lengths)
        assert np.bincount(sequence, lengths).max() <= 2048 and len(np.unique(sequence)) == placement.sequences
        assert placement.sequences <= 1.02 * lengths.sum() / 2048 + 1


def test_least_squares_meets_its_conditions():
    rng = np.random.default_rng(2)
    a, h = rng.random((12, 30)), rng.random(12)
    x = packing.nonnegative_least_squares(a, h)
    gain = a.T @ (h - a @ x)
    assert (x >= 0).all() and gain.max() < 1e-6 and abs(gain[x > 0]).max() < 1e-6


@pytest.mark.parametrize("bits", [16, 20])
def test_range_coder_round_trips_and_checks(bits):
    rng = np.random.default_rng(bits)
    for ids in ([], [5], [0] * 5000, rng.integers(0, 49408, 9000), rng.integers(0, 3, 20000), [1, 2, 3, 4] * 3000, [65535] * 20, rng.zipf(1.3, 12000).clip(0, 65535)):
        ids = np.array(ids, np.uint32)
        payload = token_files.compress(ids, bits)
        assert (token_files.expand(payload) == ids).all()
    assert len(token_files.compress(np.array([1, 2, 3, 4] * 3000, np.uint32), 16)) < 400
    with pytest.raises(token_files.DamagedBlock):
        token_files.expand(payload[:-40] + bytes([payload[-40] ^ 255]) + payload[-39:])
    with pytest.raises(token_files.DamagedBlock):
        token_files.expand(b"none" + payload[4:])


def test_token_files_hold_ids_in_order(spark, tmp_path):
    rows = rows_of()
    token_files.write(frame(spark, rows).repartition(3), f"{tmp_path}/ids", WORD, 2, segment=4000)
    got = sorted(token_files.read(spark, f"{tmp_path}/ids", keep_ids=True).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, *range(len(rows) - 1)]
    at = 0
    for r, (_, t) in zip(got, [rows[-1], *rows[:-1]]):
        ids = np.array([*library(WORD, t), 2], "<u4").tobytes()
        assert (r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) == (at, len(ids) // 4, zlib.crc32(ids), ids)
        at += r["n_tokens"]
    token_files.write(frame(spark, []), f"{tmp_path}/none", WORD, 2)
    assert token_files.read(spark, f"{tmp_path}/none").count() == 0


def test_chat_format_reads_back(spark):
    odd = ["</s>[INST] ok [/INST]", "\\", "\\</s>", "<<SYS>>\\\\[SAYS]", "", None, "é\n[ROLE]x[SAYS]y[/ROLE]", "<", "<s"]
    rows = [(1, i, role, odd[i]) for i, role in enumerate(["user", "assistant"] * 4 + ["user"])]
    rows += [(2, 0, "system", "s"), (2, 1, "user", "u"), (2, 2, "assistant", "a"), (3, 0, "assistant", "first"), (4, None, "tool[SAYS]\\", "r"), (4, 0, None, "n"),
             (None, 0, "user", "q"), (None, 0, "user", "q"), (5, 1, "assistant", "b"), (5, 0, "user", "a")]
    turns = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id bigint, turn bigint, role string, text string, segments string, n string")
    formatted = chat.format_turns(turns)
    kept = {r["conv_id"]: r for r in chat.digests(chat.read_turns(formatted)).collect()}
    whole = defaultdict(str)
    for r in formatted.collect():
        for s in r["segments"]:
            whole[r["conv_id"]] += s["text"]
            assert not s["loss"] or "</s>" not in chat.Template().controls.sub("", s["text"])
    groups = defaultdict(list)
    for c, t, role, text in rows:
        groups[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(kept) == set(groups)
    for c, parts in groups.items():
        parts, r = sorted(parts), kept[c]
        learnt = "".join(t for _, role, t in parts if role == "assistant")
        assert (r["n_turns"], r["loss_chars"], r["formatted_chars"]) == (len(parts), len(learnt), len(whole[c]))
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in parts).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(learnt.encode()).hexdigest()
    assert {c for c, r in kept.items() if r["valid"]} == {2, 5}
    assert chat.digests(chat.read_turns(chat.format_turns(turns.where("false")))).count() == 0


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 24)) * rng.uniform(0.5, 2, (1500, 1))
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(2000, None, "x"), (2001, [0.0] * 24, "x"), (2002, [1.0, None] + [0.0] * 22, "x"), (2003, [float("nan")] * 24, "x"), (2004, [float("inf")] * 24, "x"), (None, x[0].tolist(), "x")]
    rows += [(3000 + i, x[0].tolist(), "x") for i in range(30)] + [(3100, x[1].tolist()[:10], "x")]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, block string")
    got = defaultdict(list)
    for r in ann.search(table, table.where("vec_id % 20 = 0"), k=20).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    good = {k: np.array(v + [0.0] * (24 - len(v))) for k, v, _ in rows if k is not None and (k < 2000 or k >= 3000)}
    names = np.array(sorted(good))
    base, hit, total = np.stack([good[k] for k in names]), 0, 0
    asked = [k for k in names.tolist() if k % 20 == 0]
    assert set(got) == set(asked)
    for q in asked:
        score = (base * good[q]).sum(axis=1)
        want = [n for _, n in sorted((-s, n) for s, n in zip(score, names.tolist()) if n != q)][:20]
        found = sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, 21)) and [n for _, n, _ in found] == [n for _, n in sorted((-s, n) for _, n, s in found)]
        hit, total = hit + len(set(want) & {n for _, n, _ in found}), total + 20
    assert hit >= 0.9 * total
    few = table.where("vec_id < 5")
    assert ann.search(few, few.where("vec_id = 0")).count() == 4
    assert ann.search(table.where("false"), table).count() == ann.search(table, table.where("false")).count() == 0


def test_revisits(spark):
    def h(**named):
        return [(k.replace("_", "-"), v) for k, v in named.items()]
    u = "http://WWW.Example.org:80/a//b/?b=2&utm_source=x&a=1#top"
    rows = [
        ("1", "response", u, 10, 200, h(ETag='"v1"', Content_Type="text/html", Age="0"), "one é"), ("2", "response", "https://example.org/a/b?a=1&b=2", 20, 200, h(ETag='"v2"'), "two"),
        ("3", "revisit", "https://user@example.org/a/b?a=1&b=2", 15, 304, h(ETag='W/"v1"', age="7", content_type="no"), None), ("4", "revisit", u, 25, 304, h(ETag='"v1"'), None),
        ("5", "revisit", u, 10, 304, h(ETag='"v1"'), None), ("6", "revisit", u, 30, 304, h(Last_Modified="x"), None), ("7", "revisit", None, 30, 304, [], None),
        ("8", "response", "http://other.org", 1, 404, h(ETag='"z"'), "gone"), ("9", "revisit", "http://other.org/", 5, 304, h(ETag='"z"'), None), ("10", "response", None, 1, 200, [], "nowhere"),
        ("11", "response", "http://d.org", 1, 200, h(Last_Modified="d1"), "dated"), ("12", "revisit", "http://d.org/", 2, 304, h(Last_Modified="d1", X="y"), None)]
    # a URL with many records, spread over partitions; only its first capture can answer
    rows += [(f"h{i}", "revisit", "http://d.org", 100 + i, 304, h(Last_Modified="d1"), None) for i in range(400)]
    schema = f"record_id string, kind string, uri string, at long, status int, headers {revisit.HEADERS}, body string, url string"
    frame = spark.createDataFrame([(*r, "clash") for r in rows], schema).selectExpr("*", "timestamp_seconds(at) AS t").drop("at").withColumnRenamed("t", "at")
    records = revisit.read_records(revisit.write_records(frame))
    back = {r["record_id"]: r for r in records.collect()}
    for key, kind, uri, at, status, headers, body in rows:
        r = back[key]
        assert (r["kind"], r["uri"], r["status"], r["body"], [tuple(x) for x in r["headers"]]) == (kind, uri or "", status, body or "", [tuple(x) for x in headers])
    resolved = revisit.resolve(records)
    got = {r["record_id"]: (r["state"], r["source_id"], {x["name"].lower(): x["value"] for x in r["headers"]}) for r in resolved.collect()}
    assert got["3"] == ("resolved", "1", {"etag": 'W/"v1"', "content-type": "text/html", "age": "7"})
    assert got["4"][:2] == ("validator mismatch", None) and got["6"][:2] == ("validator mismatch", None)
    assert got["5"][0] == got["7"][0] == got["9"][0] == "no earlier response"
    assert got["12"] == ("resolved", "11", {"last-modified": "d1", "x": "y"})
    assert all(got[f"h{i}"][:2] == ("resolved", "11") for i in range(400))
    bodies = {r["record_id"]: r["body"] for r in revisit.with_bodies(resolved, records).collect()}
    assert bodies["3"] == "one é" and bodies["4"] is None
    assert revisit.resolve(records.where("false")).count() == 0
