"""BPE, PII, quality, language, toxicity, decontamination and chat on small inputs."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallybook.llm import bpe, chat, decontam, language, pii, quality, queries, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
ODD = [(1, None), (2, ""), (3, "a<|endoftext|>b <|endoftext|>"), (4, "  x\n\n y\t"), (5, "Ω՘꭬é'll don't   x"), (6, "日本語 1234 😀"), (7, "\x00\x1c a\x85b"), (8, "word " * 5000), (8, "other"), (None, "null id"), (4, "  x\n\n y\t")]


@pytest.mark.parametrize("chunk_bytes", [1 << 24, 1])
def test_bpe_round_trip(docs_of, chunk_bytes):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary_path())
    want = []
    for i, text in ODD:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = bpe.encode_documents(docs_of(ODD), queries.vocabulary_path(), bpe.digests, bpe.DIGESTS, chunk_bytes).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.encode_documents(docs_of([]), queries.vocabulary_path(), chunk_bytes=chunk_bytes).count() == 0


@pytest.mark.parametrize("chunk_bytes", [1 << 24, 1])
def test_bpe_piece_of_many_ids(docs_of, chunk_bytes):
    from tokenizers import Tokenizer

    r = random.Random(2)
    rows = [(i, f"plain words {i} of doc {i * 7}") for i in range(40)] + [(50, "".join(chr(r.randrange(0x4E00, 0x9F00)) for _ in range(40_000)))]
    t = Tokenizer.from_file(queries.vocabulary_path())
    want = {i: t.encode(text, add_special_tokens=False).ids for i, text in rows}
    assert len(want[50]) > 65_535
    got = {x.doc_id: np.frombuffer(x.ids, "<u4").tolist() for x in bpe.encode_documents(docs_of(rows), queries.vocabulary_path(), chunk_bytes=chunk_bytes).collect()}
    assert got == want


def test_bpe_cuts_as_the_library_does():
    import pyarrow as pa

    own, r = bpe.splitter(queries.vocabulary_path()), random.Random(1)
    letters = [*"aab  '''stremvld  \n\n\t\r\x0b\x1c\x85\xa0 12\xb2١.,!-éßçñЖ中文ǅ́　", "'re", "'ll", "'s", " '", "<|endoftext|>", "😀", " ", "﻿"]
    for _ in range(300):
        rows = ["".join(r.choice(letters) for _ in range(r.randrange(25))) for _ in range(6)] + [None, ""]
        pieces = bpe.Pieces(pa.array(rows, pa.string()), own)
        flat, at = pieces.texts(np.arange(len(pieces.hash))).to_pylist(), 0
        for text, n in zip(rows, pieces.count, strict=True):
            assert flat[at : at + n] == (own.pieces(text) if text else [])
            at += n


def test_pii(docs_of):
    rows = [
        (1, "mail a.b+c@x-1.example.org now"), (2, "at 10.0.255.1 and 300.1.1.1 and 1.2.3.4.5.6.7.8"), (3, "card 4111 1111 1111 1111 or 4111 1111 1111 1112"), (4, "+1 (415) 555-0100 +12 3"),
        (5, "iban DE89 3704 0044 0532 0130 00 and GB00 WEST 1234 5698 7654 32"), (6, 'token = "abcdefabcdef1234abcd"'), (7, None), (8, ""), (9, "x@" * 2000), (10, "1" * 30000 + " a@b.c"), (11, "é😀 q@w.e 日"), (11, "é😀 q@w.e 日"),
    ]
    got = {r.doc_id: r for r in pii.found(docs_of(rows)).collect()}
    assert got[1].spans == "email:5:26" and got[2].spans == "ip:3:13,ip:32:39,ip:40:47" and got[2].n_ip == 3
    assert got[3].n_card == 1 and got[3].spans == "card:5:24" and got[4].spans == "phone:0:17"
    assert got[5].spans.startswith("iban:5:32") and "iban:3" not in got[5].spans and got[6].spans == "secret:0:30"
    assert got[7].base_sha256 == got[8].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[10].n_email == 1 and got[11].spans == "email:3:8"
    masked = {r.doc_id: r for r in pii.masked(docs_of(rows)).collect()}
    assert masked[1].text == "mail [EMAIL] now" and masked[1].n_chars == len("mail [EMAIL] now") and masked[7].text is None and masked[11].text == "é😀 [EMAIL] 日"
    assert pii.masked(docs_of(rows)).columns == docs_of(rows).columns and pii.found(docs_of([])).count() == 0


def test_iban_before_capitals(docs_of):
    rows = [(1, "IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFF"), (2, "IBAN DE89370400440532013000 Please confirm"), (3, "GB29 NWBK 6016 1331 9268 19 DE89 3704 0044 0532 0130 00 12"), (4, "XX12 ABCD 1234 5678 DE89 3704 0044 0532 0130 00"), (5, "DE89 3704 0044 0532 0130 01 BIC"), (6, "DE893704004405320130001 BIC")]
    got = {r.doc_id: r.spans for r in pii.found(docs_of(rows)).collect()}
    iban = {i: [x for x in s.split(",") if x.startswith("iban")] for i, s in got.items()}
    assert iban == {1: ["iban:5:32"], 2: ["iban:5:27"], 3: ["iban:0:27", "iban:28:55"], 4: ["iban:20:47"], 5: [], 6: []}
    assert pii.masked(docs_of(rows[:1])).first().text == "IBAN [IBAN] BIC COBADEFF"


def test_quality_order_does_not_matter(docs_of, make_text):
    make_text = lambda seed, n, f=make_text: f(seed, n).translate({48 + i: 103 + i for i in range(10)})
    rows = [(1, make_text(1, 80)), (2, None), (3, ""), (4, "a b c " * 60), (5, make_text(2, 60).upper()), (6, make_text(3, 60) + " ###" * 9), (7, "\n".join(["same line of words here"] * 30 + [make_text(4, 90)])), (7, make_text(1, 80))]
    first = sorted(map(tuple, quality.judge(docs_of(rows)).drop("rejected_by").collect()), key=str)
    names = list(quality.rules())
    assert first == sorted(map(tuple, quality.judge(docs_of(rows), names[::-1]).drop("rejected_by").collect()), key=str)
    by = {r[0]: r for r in first if r[0] != 7}
    assert by[4][5] == 180 and by[4][6] and not by[4][7] and by[2][1] == 0 and by[1][7] and not by[6][7]
    assert quality.judge(docs_of([])).count() == 0


def test_language_held_out(spark, docs_of):
    r = random.Random(3)
    stock = {"aa": ["bala", "kelo", "miri", "tano"], "bb": ["schu", "weng", "pfar", "zutt"], "cc": ["ción", "ñero", "lluv", "rrio"]}
    rows = []
    for i in range(300):
        lang = list(stock)[i % 3]
        rows.append((i, " ".join("".join(r.choices(stock[lang], k=r.randrange(1, 4))) for _ in range(20)), lang))
    df = spark.createDataFrame([*rows, (900, None, "aa"), (901, "123 !!", "aa"), (902, "", None)], "doc_id long, text string, lang string")
    model = language.fit(df.where(language.training_rows(df)))
    got = {x.doc_id: x for x in language.predict(df, model).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang in rows) >= 297
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert {x.lang_pred for x in language.predict(df, language.fit(df.limit(0))).collect()} == {"und"}


def test_toxicity_held_out(spark, make_text):
    r = random.Random(5)
    bad = ["hateful", "rotten", "vermin", "loathsome"]
    rows, marks = [], []
    for i in range(600):
        words = make_text(i, 60).split()
        if toxic := i % 3 == 0:
            for _ in range(4):
                words[r.randrange(60)] = r.choice(bad)
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    docs, labels = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string"), spark.createDataFrame([*marks, (None, 1), (5, None)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert sum(got[i].predicted == t for i, t in marks) >= 570
    assert got[900].predicted == got[901].predicted == 0
    assert {x.score for x in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()} == {0.0}


def test_decontamination(spark, docs_of, make_text):
    item = "Maria bought 12 apples for 3 dollars and then she gave 12 of the apples to Peter who ate 5 of them before noon"
    other = item.replace("12", "40").replace("Peter", "Johann").replace(" 3 ", " 7 ")
    broken = item.replace("gave 12 of the", "gave 99 of the")
    bench = spark.createDataFrame([(1, item), (2, make_text(77, 30)), (3, None), (4, "short one"), (1, item)], "item_id long, text string")
    rows = [(10, make_text(1, 100) + " " + item + " " + make_text(2, 50)), (11, make_text(3, 90) + ". " + other), (12, make_text(4, 120)), (13, " ".join(make_text(77, 30).split()[:6]) + " " + make_text(5, 50)), (14, None), (15, ""), (16, make_text(77, 30).upper()), (10, "same id, clean text")]
    got = {(r.doc_id, r.item_id): r for r in decontam.found(docs_of(rows), bench).collect()}
    assert set(got) == {(10, 1), (11, 1), (16, 2)}
    assert got[11, 1].reparameterised and not got[10, 1].reparameterised
    assert decontam.covered_words([(0, 5, "12", "40"), (1, 6, "12", "40"), (2, 7, "12", "99")], 5) == (6, True)
    assert broken != item
    plain = {(r.doc_id, r.item_id) for r in decontam.leaks(docs_of(rows), bench, broadcast_hashes=0).collect()}
    assert plain == set(got)
    left = decontam.without_leaks(docs_of(rows), bench)
    assert sorted(r.doc_id for r in left.collect()) == [10, 12, 13, 14, 15] and left.columns == docs_of(rows).columns
    assert decontam.found(docs_of([]), bench).count() == 0 and decontam.found(docs_of(rows), bench.limit(0)).count() == 0


def test_decontamination_of_dense_items(spark, docs_of, make_text):
    items = ["If 3x + 7 = 22 and 2y - 5 = 11, what is x + y?", "Compute 12 + 7 * 3 - 4 / 2 and round to 2 decimal places.", "What is 17 + 25 + 33 - 12 + 8 - 4?", "In 1914 Archduke Franz Ferdinand of Austria and Sophie Chotek were killed in Sarajevo by Gavrilo Princip.", "91 25 33 12"]
    changed = items[3].replace("1914", "1931").replace("Sarajevo", "Belgrad")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = [(10 + k, make_text(k, 60) + ". " + x + " " + make_text(20 + k, 40)) for k, x in enumerate([*items, changed])]
    rows += [(20, make_text(40, 90)), (21, make_text(41, 60) + ". What is 18 + 26 + 34 - 13 + 9 - 5? " + make_text(42, 9))]
    for most in (decontam.BROADCAST_HASHES, 0):
        got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs_of(rows), bench, broadcast_hashes=most).collect()}
        assert got == {(10, 0), (11, 1), (12, 2), (13, 3), (14, 4), (15, 3)}


def test_decontamination_of_edited_and_partial_items(spark, docs_of, make_text):
    words = make_text(88, 59).split()
    short = make_text(89, 24).split()
    bench = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(short))], "item_id long, text string")
    inside = lambda k, w: (k, make_text(60 + k, 40) + " " + " ".join(w) + " " + make_text(90 + k, 40))
    rows = [inside(1, [*short[:12], "put", "in", *short[12:]]), inside(2, [*short[:11], *short[13:]]), inside(3, words[10:50]), inside(4, words[:13]), inside(5, words[:12]), inside(6, [*short[12:], *make_text(5, 30).split(), *short[:12]])]
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs_of(rows), bench).collect()}
    assert got == {(1, 2), (2, 2), (3, 1), (4, 1)}
    far = [(j, j + 100 * (j >= 6), "", "") for j in range(14) if j not in (4, 5)]
    assert decontam.covered_words(far, 5)[0] < 18 and decontam.covered_words([(j, j + 2 * (j >= 6), "", "") for j, *_ in far], 5)[0] == 18


@pytest.mark.parametrize("text", ["", "\\", "a\\b", "</s>", "<\\/s>", "[TURN][TEXT]</s><s>", "<<s>/s>", "[[INST]INST]", "</</s>s>", "\\\\</s>\\"])
def test_escape_is_reversible(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text and not any(c in out for c in chat.CONTROL)


def test_escape_random():
    r = random.Random(1)
    parts = [*chat.CONTROL, "\\", "<", "/", "s", ">", "[", "INST", "é"]
    for _ in range(3000):
        text = "".join(r.choices(parts, k=r.randrange(9)))
        out = chat.escape(text)
        assert chat.unescape(out) == text and not any(c in out for c in chat.CONTROL)


def test_chains_and_trees(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 1, "assistant", None), (2, 0, "user", said), (2, 1, "assistant", said), (3, None, None, "x"), (4, 0, "assistant", "y" * 50000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.conversations_of(chat.chains(table))).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1].n_turns == 3 and got[1].loss_chars == 1 and got[2].loss_sha256 == sha(said) and got[2].turns_sha256 == sha(f"user\n{said}\nassistant\n{said}\n")
    assert got[3].turns_sha256 == sha("\nx\n") and got[4].loss_chars == 50000 and len(got) == 4
    assert chat.digests(chat.conversations_of(chat.chains(table.limit(0)))).count() == 0
    # a tree: 1 -> 2 -> 4, 1 -> 3 -> 5 -> 6; leaf 4 scores 5, leaf 6 scores 3
    tree = spark.createDataFrame([(9, 1, None, 0.0), (9, 2, 1, 1.0), (9, 3, 1, 1.0), (9, 4, 2, 4.0), (9, 5, 3, 1.0), (9, 6, 5, 1.0)], "tree long, node long, parent long, score double")
    forest = tree.withColumn("role", F.lit("user")).withColumn("text", F.col("node").cast("string"))
    best = chat.conversations_of(forest, best=2).orderBy("rank").collect()
    assert [[t for _, t in chat.read_back(r.formatted)] for r in best] == [["1", "2", "4"], ["1", "3", "5", "6"]]
    deep = spark.range(40).select(F.lit(1).cast("long").alias("tree"), F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit(0.0).alias("score"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    assert [t for _, t in chat.read_back(chat.conversations_of(deep).first().formatted)] == [str(i) for i in range(40)]


def test_circles_and_repeated_messages(spark):
    rows = [(1, 1, None, "a"), (1, 2, 1, "b"), (1, 2, 1, "b"), (1, 2, 1, "b"), (2, 1, 2, "x"), (2, 2, 1, "y"), (2, 3, 2, "z"), (3, 1, 99, "orphan"), (3, 5, 5, "self")]
    forest = spark.createDataFrame(rows, "tree long, node long, parent long, text string").selectExpr("tree", "node", "parent", "0D AS score", "'user' AS role", "text")
    got = {r.tree: [t for _, t in chat.read_back(r.formatted)] for r in chat.conversations_of(forest).collect()}
    assert got == {1: ["a", "b"], 3: ["orphan"]}


def test_language_against_word_by_word(spark):
    import math

    r = random.Random(8)
    stock = {"aa": ["lo", "mi", "réta"], "bb": ["kur", "dáß", "zen"], "cc": ["xu", "mi", "qe"]}
    make = lambda lang, n: " ".join("".join(r.choices(stock[lang], k=r.randrange(1, 3))) for _ in range(n))
    rows = [(i, make(list(stock)[i % 3], 8), list(stock)[i % 3]) for i in range(60)]
    asked = [(100 + i, make(list(stock)[i % 3], 5) + " kurmi dáßqe neu xuxuxu 12") for i in range(9)] + [(200, "ZEN İx ́a"), (201, "ſ ς ΑΣ")]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    words, grams, langs = {}, {}, sorted(stock)
    for _, text, lang in rows:
        for w in text.split():
            words.setdefault(w, dict.fromkeys(langs, 0))[lang] += 1
            for k in language.ORDERS:
                for i in range(len(w) + 3 - k):
                    grams.setdefault(f"<{w}>"[i : i + k], dict.fromkeys(langs, 0))[lang] += 1
    total = {x: sum(n[x] for n in words.values()) + 1 for x in langs}
    single = {x: sum(n[x] for g, n in grams.items() if len(g) == 1) for x in langs}

    def gram(g, x):
        n = grams[g][x]
        context = single[x] if len(g) == 1 else grams.get(g[:-1], grams[g])[x]
        return math.log((n + 0.05) / (max(context, n) + 1))

    def word(w, x):
        if w in words:
            return math.log((words[w][x] + 0.05) / total[x])
        text, out = f"<{w}>", 0.0
        for end in range(2, len(text) + 1):
            known = next(((s, k) for s, k in enumerate(language.ORDERS) if k <= end and text[end - k : end] in grams), None)
            out += math.log(0.05 / (single[x] + 1)) + len(language.ORDERS) * math.log(language.BACKOFF) if known is None else gram(text[end - known[1] : end], x) + known[0] * math.log(language.BACKOFF)
        return out

    import regex

    got = {x.doc_id: x for x in language.predict(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    for i, text in asked:
        cut = regex.findall(language.LETTERS, text.lower())
        score = [sum(word(w, x) for w in cut) / len(cut) * min(len(cut), language.EVIDENCE) for x in langs]
        top = [math.exp(v - max(score)) for v in score]
        assert got[i].lang_pred == langs[score.index(max(score))] and abs(got[i].score - max(top) / sum(top)) < 1e-4


def test_pii_of_very_many_spans(docs_of):
    r = random.Random(6)
    parts, spans, at = [], [], 0
    for i in range(700):
        word = r.choice([f"u{i}@h.org", "10.0.0.7", "4111 1111 1111 1111", "12", "+1 415 555 0100", 'token="abcdefghij0123456789"', "é"])
        kind = {"u": "email", "1": "ip" if "." in word else "", "4": "card", "+": "phone", "t": "secret", "é": ""}[word[0]]
        if kind:
            spans.append((["email", "ip", "card", "phone", "iban", "secret"].index(kind), at, at + len(word), kind))
        parts.append(word)
        at += len(word) + 3
    text = " ; ".join(parts)
    rows = docs_of([(1, text)])
    assert pii.found(rows).first().spans == ",".join(f"{k}:{a}:{b}" for _, a, b, k in sorted(spans))
    want, last = [], 0
    for a, b, k in sorted((a, b, k) for _, a, b, k in spans):
        want += [text[last:a], f"[{k.upper()}]"]
        last = b
    assert pii.masked(rows).first().text == "".join(want) + text[last:]


def test_columns_of_any_name(spark, make_text):
    import corpus_pipeline

    names = ["pii_spans", "__spans", "__score", "__lang_pred", "__key", "__rid", "__node", "a.b", "kept", "chunk", "rid"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    docs = spark.createDataFrame([(i, make_text(i, 60) + f" a{i}@b.org", "en", "s", 1, *names) for i in range(4)], schema)
    items = spark.createDataFrame([(1, make_text(99, 20))], "item_id long, text string")
    for after in (pii.masked(docs), decontam.without_leaks(docs, items), corpus_pipeline.near_duplicate_stage(spark, docs, ""), corpus_pipeline.language_stage(spark, docs, "")):
        assert after.columns == docs.columns and [tuple(r)[5:] for r in after.collect()] == [tuple(names)] * 4


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = corpus_pipeline.run(spark, sf)
    ids = [r.doc_id for r in got.select("doc_id").collect()]
    assert 0 < len(ids) == len(set(ids)) <= docs.count() and [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "pii", "bpe"]
