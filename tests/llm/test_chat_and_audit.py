"""Chat formatting and the filter audit, against brute force and on odd tables."""

import hashlib
import itertools
import random
import re
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quillspark.llm import chat, interaction, queries

SAID = "conv_id long, turn long, role string, text string, formatted string, place string"


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# --- chat formatting


def chats(df):
    return chat.format_chats(df.withColumn("parts", chat.text_part(F.col("text"))))


def test_texts_and_marks_survive_the_round_trip(spark):
    rng = random.Random(5)
    bits = ["\\", "<", ">", "</turn>", "<turn user>", "\\l", "\\b", "\\g", "<image 0>", "\n", "é𝄞", "", "b", "l", "### Assistant:", "</turn>\n"]
    said = [(c, t, rng.choice(["user", "assistant", "sys>\\tem", ""]), "".join(rng.choices(bits, k=rng.randint(0, 12))), "x", "y") for c in range(40) for t in range(rng.randint(1, 6))]
    rng.shuffle(said)
    got = {r["conv_id"]: r for r in rows(chats(spark.createDataFrame(said, SAID)).withColumn("back", chat.read(F.col("formatted"))).withColumn("learned", chat.under_loss(F.col("formatted"), F.col("loss"))))}
    assert len(got) == 40
    for c, r in got.items():
        mine = sorted((x for x in said if x[0] == c), key=lambda x: x[1])
        assert [(t["role"], t["text"]) for t in r["back"]] == [(x[2], x[3]) for x in mine] and r["n_turns"] == len(mine)
        assert r["learned"] == [x[3] for x in mine if x[2] == "assistant"]
        assert r["formatted"].count("</turn>\n") == len(mine) and r["formatted"].count("<") == 2 * len(mine)
        raw = r["formatted"].encode()
        assert all(raw[: s["begin"]].endswith(b"<turn assistant>") and raw[s["begin"] + s["bytes"] :].startswith(b"</turn>\n") for s in r["loss"])


def test_parts_become_numbered_placeholders(spark):
    part = lambda kind, text=None, ref=None, w=None, h=None, s=None, p=None: (kind, text, ref, w, h, s, p)
    talk = [
        (1, 0, "user", [part("text", "look <"), part("image", ref="a.png", w=57, h=28), part("text", "turn user> here"), None, part("audio", ref="b.wav", s=1.5)]),
        (1, 1, "assistant", [part("text", "two words"), part("video", ref="c.mp4"), part("image", ref="d.png", w=-4, h=28)]),
        (1, 2, "user", [part("document", "of three words", "e.pdf", p=2), part(None, "end")]),
        (2, 0, "user", None),
    ]
    df = spark.createDataFrame(talk, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    one, two = sorted(rows(chat.format_chats(df).withColumn("back", chat.read(F.col("formatted"))).withColumn("learned", chat.under_loss(F.col("formatted"), F.col("loss")))), key=lambda r: r["conv_id"])
    assert one["formatted"] == "<turn user>look \\l<image 0>turn user\\g here<audio 1></turn>\n<turn assistant>two words<other 2><image 3></turn>\n<turn user><document 4>end</turn>\n"
    assert [(a["number"], a["turn"], a["type"], a["ref"], a["tokens"]) for a in one["attachments"]] == [(0, 0, "image", "a.png", 3), (1, 0, "audio", "b.wav", 38), (2, 1, "other", "c.mp4", 0), (3, 1, "image", "d.png", 0), (4, 2, "document", "e.pdf", 515)]
    assert one["tokens"] == 2 + 3 + 3 + 38 + 2 + 515 + 1 and one["learned"] == ["two words"]
    assert [t["placeholders"] for t in one["back"]] == [["image 0", "audio 1"], ["other 2", "image 3"], ["document 4"]] and one["back"][0]["text"] == "look <turn user> here"
    assert two["formatted"] == "<turn user></turn>\n" and two["attachments"] == [] and two["loss"] == []


def test_odd_conversations(spark):
    long = "word < " * 200_000
    said = [(None, None, None, None), (None, 1, "assistant", "a"), (3, 0, "assistant", long), (3, 0, "assistant", long), (3, None, "user", ""), (4, 0, "assistant", None)]
    df = spark.createDataFrame([(*s, "clash", "clash") for s in said], SAID)
    got = {r["conv_id"]: r for r in rows(chats(df))}
    assert got[None]["formatted"] == "<turn ></turn>\n<turn assistant>a</turn>\n" and got[3]["n_turns"] == 3
    assert got[3]["formatted"].startswith("<turn user></turn>\n") and [s["bytes"] for s in got[3]["loss"]] == [len(long) + 200_000] * 2
    assert got[4]["loss"] == [{"begin": 16, "bytes": 0}]
    assert chats(df.where("false")).count() == 0


def test_chat_query_on_the_table(spark):
    got = {r["conv_id"]: r for r in rows(queries.op11_chat_parts(spark, "/root/testdata/sf0.001"))}
    said = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()
    for c in {r["conv_id"] for r in said}:
        mine = sorted((r for r in said if r["conv_id"] == c), key=lambda r: r["turn"])
        told = "".join(f"{r['role']}\n{r['text'] or ''}\n" for r in mine)
        learned = "".join(r["text"] or "" for r in mine if r["role"] == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(mine), hashlib.sha256(told.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    said = r"\### Assistant: </turn> ok"
    assert got[-7]["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest() and got[-7]["loss_chars"] == len(said)


# --- filter audit


def fails(text, first):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(w) < 50,
        "B": 100 * len(set(w)) < 65 * len(w),
        "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
        "D": bool(re.search("[#$%&*|]", text)),
        "E": first,
    }


def brute(docs, labels):
    """The audit by walking through the documents in each order."""
    seen = {}
    for i, text, _ in docs:
        if i is not None and i < seen.get(text or "", i + 1):
            seen[text or ""] = i
    good, toxic = ({i for i, *m in labels if m[k] == 1} for k in (0, 1))
    judged = [(s or "", i, fails(t or "", i is not None and i > seen[t or ""])) for i, t, s in docs]
    out, share = {}, Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in {p for p, _, _ in judged}:
            left = [d for d in judged if d[0] == part]
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[2][f]]
                alone = sum(sum(d[2].values()) == 1 and d[2][f] for d in judged if d[0] == part)
                redundant = sum(d[2][f] for d in judged if d[0] == part) - len(gone)
                left = [d for d in left if not d[2][f]]
                share[part, f] += len(gone)
                out[part, order, step] = [len(left), len(gone), redundant, alone, sum(d[1] in good for d in gone if d[1] is not None), sum(d[1] in toxic for d in gone if d[1] is not None)]
    return {k: (*v, share[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_against_brute_force(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "Gamma", "DELTA", "eps$", "ζ", "eta", *(f"w{i}" for i in range(80))]
    texts = [" ".join(rng.choices(words[: rng.choice([7, 87])], k=rng.choice([3, 49, 50, 90]))) for _ in range(60)] + ["", None]
    docs = [(rng.choice([None, *range(200)]), rng.choice(texts), rng.choice(["a", "b", None, ""])) for _ in range(400)]
    docs += [(1000 + i, "the same text in each of these", "hot") for i in range(1500)]
    labels = [(rng.randint(0, 1600), rng.randint(0, 1), rng.randint(0, 1)) for _ in range(300)] + [(None, 1, 1)]
    df = spark.createDataFrame([(*d, "clash", "clash") for d in docs], "doc_id long, text string, source string, digest string, part string")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[k] for k in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in rows(interaction.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))}
    assert got == brute(docs, labels)
    empty = spark.createDataFrame([], df.schema)
    assert interaction.audit(empty, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_removal_polynomial():
    counts = {0b00011: 6, 0b00100: 5, 0b11111: 7, 0: 9}
    r = interaction.Removal(counts)
    for chosen in range(32):
        assert r.at(chosen) == sum(n for m, n in counts.items() if m & chosen)
    assert r.shapley(0) == Fraction(6, 2) + Fraction(7, 5) and sum(map(r.shapley, range(5))) == 18
    assert r.derivative(2) == [12, -28, 42, -28, 7]  # 5 + 7 (1 - t)^4


def test_audit_of_odd_documents(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    got = rows(interaction.audit(odd, labels))
    assert len(got) == 600 * odd.select(F.coalesce("source", F.lit(""))).distinct().count()
    assert sum(r["removed"] for r in got if r["filter_order"] == "EDCBA" and r["step"] == 1) == 2  # document 2 copies 1, and the empty text the null one


@pytest.mark.parametrize("name", ["op11_chat_parts", "op12_filter_audit"])
def test_native_and_narrow(spark, name):
    plan = getattr(queries, name)(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and ("Python" not in plan and "MapInPandas" not in plan or name != "op11_chat_parts")
