"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns with clashing names."""

import itertools
import math
import random
import re
import unicodedata
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import conversations, defects, overlap, packing, splits, splitting, stuffing, tokenize, topn

MESSAGE = "id long, thread_id string, message_id string, ordinal int, type string, role string, content string, tool_calls string, received_at timestamp, block int, n int, symbol string"


def msgs(spark, *rows):
    """(thread, message_id, ordinal, role, type, content, tool_calls)"""
    return spark.createDataFrame([(i, t, m, o, ty, r, c, tc, None, 7, 7, "z") for i, (t, m, o, r, ty, c, tc) in enumerate(rows)], MESSAGE)


def found(spark, threads, *rows, block=4096):
    t = spark.createDataFrame([(x, "s") for x in threads], "thread_id string, state string")
    return {r.thread_id: r.reason for r in conversations.left_out(t, msgs(spark, *rows), block).collect()}


U, A = ("user", "human"), ("assistant", "ai")


def talk(thread, *turns):
    return [(thread, None, i, *who, f'"{text}"', None) for i, (who, text) in enumerate(turns)]


def test_conversations_by_case(spark):
    rows = [
        *talk("GOOD ", (("system", "system"), "s"), (U, "a"), (A, "b"), (A, "c"), (U, "d"), (A, "e")),
        *talk("late", (U, "a"), (A, "b"), (U, "c")),
        *talk("first", (A, "a"), (U, "b"), (A, "c")),
        *talk("blank", (U, "a"), (A, "\\u200b \\u3000")),
        ("gap", "m", 0, *U, '"a"', None), ("gap", "n", 2, *A, '"b"', None),
        ("twice", "m", 0, *U, '"a"', None), ("twice", "n", 0, *A, '"b"', None),
        ("clash", "m", 0, "user", "ai", '"a"', None), ("clash", "n", 1, *U, '"a"', None), ("clash", "o", 2, *A, '"a"', None),
        ("role", "m", 0, None, "human", '{"text": "a"}', "[]"), ("role", "n", 1, " AI", "unknown", '[{"type": "text", "text": "b"}]', "null"),
        ("again", "m", 0, *U, '"a"', None), ("again", "m", 0, "USER", "human", '"a"', None), ("again", "n", 1, *A, '"b"', None),
        ("tool", "m", 0, *U, '"a"', None), ("tool", "n", 1, *A, '"b"', '[{"id": 1}]'), ("tool", "o", 2, "tool", "tool", '"r"', None),
        ("nul", "m", None, *U, '"a"', None), ("other", "m", 0, *U, '"a"', None), (None, "m", 0, *U, '"a"', None),
        ("only", "m", 0, *U, "null", None), ("only", "n", 1, *A, None, None),
    ]
    names = ["good", "late", "first", "blank", "gap", "twice", "clash", "role", "again", "tool", "nul", "none", "only", "GOOD", None]
    want = {"late": "missing_reply", "first": "broken", "blank": "missing_reply", "gap": "broken", "twice": "broken", "clash": "broken", "tool": "missing_reply", "nul": "broken", "none": "empty", "only": "empty"}
    assert found(spark, names, *rows) == want
    assert found(spark, names, *rows, block=2) == want  # the automaton over blocks composes
    assert found(spark, []) == {} and found(spark, ["a"]) == {"a": "empty"}
    t = spark.createDataFrame([(x,) for x in names], "thread_id string")
    turns = [tuple(r) for r in conversations.conversations(t, msgs(spark, *rows), 2).orderBy("thread_id", "turn").collect()]
    assert [x for x in turns if x[0] == "good"] == [("good", i, w, x) for i, (w, x) in enumerate([("user", "a"), ("assistant", "b"), ("assistant", "c"), ("user", "d"), ("assistant", "e")])]
    assert {x[0] for x in turns} == {"good", "role", "again"}


def brute_state(symbols):
    kept = [s for s in symbols if s in "ua"]
    if "x" in symbols or kept and kept[0] == "a":
        return "broken"
    return "missing_reply" if any(s == "u" and n != "a" for s, n in zip(kept, [*kept[1:], None])) else None


@settings(max_examples=300, deadline=None)
@given(st.text("ua-x", max_size=12))
def test_automaton(symbols):
    state = 0
    for s in symbols:
        state = conversations.NEXT[state][conversations.SYMBOLS.index(s)]
    got = "broken" if state == 5 else "missing_reply" if state in (1, 3, 4) else None
    assert got == brute_state(symbols)


@settings(max_examples=300, deadline=None)
@given(st.text("ab。，\n 卷#1.第章<>《》𠀀", max_size=120), st.integers(2, 30), st.integers(0, 6))
def test_pieces_lose_nothing_and_end_where_sentences_do(text, most, overlap):
    overlap = min(overlap, most - 1)
    p = splitting.pieces(text, most, overlap)
    assert "".join(text[a + (overlap if i else 0) : b] for i, (a, b) in enumerate(p)) == text
    assert all(a >= 0 and 0 < b - a <= most for a, b in p)
    for i, (a, b) in enumerate(p[:-1]):
        assert p[i + 1][0] == b - overlap
        if i == 0 and 0 <= text.find("。") < overlap - 1:
            continue  # the first piece must hold the whole overlap, so it can't end where its first sentence does
        new = text[p[i - 1][1] if i else 0 : b]
        if not re.search(r"(?:[。\n]|\.\s*)[《》》 ]*$", new) and "。" in new.rstrip("》 "):
            assert text[b : b + 1] in "》" or not re.search(r"。(?!》)", new[:-1]), (p, new)


def test_segments_follow_the_tree():
    """No segment joins children of two parents one of which doesn't fit; headings and lists nest."""
    text = "# A\n" + "甲乙丙丁。" * 3 + "\n## A.1\n" + "子丑寅卯。" * 8 + "\n## A.2\n辰巳。\n## A.3\n午未。\n# B\n申酉。\n## B.1\n戌亥。\n"
    got = [text[a:b] for a, b in splitting.segments(text, 40)]
    assert "".join(got) == text
    assert got[0].startswith("# A") and "## A.1" not in got[0]
    assert [x for x in got if "A.2" in x] == ["## A.2\n辰巳。\n## A.3\n午未。\n"]  # siblings merge, and not with what follows their parent
    assert got[-1] == "# B\n申酉。\n## B.1\n戌亥。\n"  # a parent that fits stays whole
    items = "引。\n- 一\n  - 一之一，" + "丙" * 9 + "\n  - 一之二\n    - 深\n- 二\n  - 二之一\n- 三" + "丁" * 30
    got = [items[a:b] for a, b in splitting.segments(items, 24)]
    assert "".join(got) == items
    assert got[:4] == ["引。\n", "- 一\n  - 一之一，丙丙丙丙丙丙丙丙丙\n", "  - 一之二\n    - 深\n", "- 二\n  - 二之一\n"]
    deep = "\n".join(" " * i + "- 层" for i in range(1500))
    assert "".join(deep[a:b] for a, b in splitting.segments(deep, 100)) == deep


def test_nested_sections_are_never_joined_across_parents():
    rng = random.Random(21)
    for _ in range(200):
        text, owner = "", []
        for i in range(rng.randint(2, 6)):
            for j in range(rng.randint(1, 4)):
                part = (f"# 章{i}\n" if not j else f"## 节{i}.{j}\n") + "某句。" * rng.randint(1, 9) + "\n"
                text, owner = text + part, owner + [i] * len(part)
        room = rng.randint(20, 60)
        sizes = Counter(owner)
        segs = splitting.segments(text, room)
        assert "".join(text[a:b] for a, b in segs) == text and all(b - a <= room for a, b in segs)
        for a, b in segs:
            inside = set(owner[a:b])
            assert len(inside) == 1 or all(sizes[i] <= room for i in inside)


def test_split_oversized(spark):
    long = "好。" * 20000 + "末"
    items = spark.createDataFrame([("parent", "a", "一二三。四五六七八。", 1), ("parent", "a", "一二三。四五六七八。", 2), ("parent", "b", "短", 3), ("parent", "c", None, 4), ("parent", None, "一二三四五六七八九十" * 3, 5), ("chunk", "a", "abcdefgh", 6), ("x", "a", "q" * 99, 7), ("parent", "long", long, 8)], "item_kind string, item_id string, text string, most int")
    limits = spark.createDataFrame([("parent", 6, 2), ("chunk", 7, None)], "item_kind string, max_chars int, overlap_chars int")
    got = splitting.split_oversized(items, limits).collect()
    assert [(r.piece, r.text) for r in sorted(got) if (r.item_kind, r.item_id) == ("parent", "a")] == [(0, "一二三。"), (1, "三。四五六七"), (2, "六七八。")]
    assert "".join(r.text[2 if r.piece else 0 :] for r in sorted(got) if r.item_id == "long") == long
    assert sorted(tuple(r) for r in splitting.oversized(items, limits).collect()) == [("chunk", "a"), ("parent", "a"), ("parent", "long")]
    assert splitting.split_oversized(items.limit(0), limits).count() == 0
    with pytest.raises(ValueError):
        splitting.pieces("abc", 2, 2)


def test_top_n_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(4000):
        g = "hot" if i % 3 == 0 else f"g{rng.randrange(40)}"
        rows.append((i, f"q{rng.randrange(60)}", "s", f"c{rng.randrange(9)}", rng.randrange(4), g, float(rng.randrange(5)), "x"))
    rows += [(i + 10_000, *r[1:]) for i, r in enumerate(rows[:300])]
    rows += [(9001, "q", "s", "n", 1, "g1", float("nan"), ""), (9002, "q", "s", "m", 1, None, 9.0, ""), (9003, "q", "s", "o", 1, "g1", None, ""), (9004, None, None, None, None, "solo", 1.0, ""), (9005, None, None, None, 2, "solo", 1.0, "")]
    schema = "hit_id long, qa_id string, strategy string, chunk_id string, rank int, parent_id string, score double, low string"
    df = spark.createDataFrame(rows, schema).repartition(5)
    best: dict = defaultdict(dict)
    for h, q, s, c, r, p, x, _ in rows:
        if p is not None and x is not None and not math.isnan(x):
            key = (-x, r is None, r or 0, h)
            best[p][q, s, c] = min(best[p].get((q, s, c), key), key)
    want = {(p, k[3]) for p, m in best.items() for k in sorted(m.values())[:5]}
    for size in (8192, 64, 3):
        got = topn.top_n(df, 5, "parent_id", "score", ["rank", "hit_id"], ["qa_id", "strategy", "chunk_id"], size)
        assert {(r.parent_id, r.hit_id) for r in got.collect()} == want
    whole = df.withColumn("score", F.when(~F.isnan("score"), F.col("score").cast("long") + F.lit(2**53)))
    assert {(r.parent_id, r.hit_id) for r in topn.top_n(whole, 5, "parent_id", "score", ["rank", "hit_id"], ["qa_id", "strategy", "chunk_id"], 64).collect()} == want
    assert topn.top_n(df.limit(0), 5, "parent_id", "score", ["rank", "hit_id"], ["qa_id"]).count() == 0


def test_row_groups_of_a_crowded_group_are_skipped(spark):
    rows = [(i, "hot", float(i % 977)) for i in range(30_000)] + [(i, f"g{i % 70}", float(i)) for i in range(30_000, 31_000)]
    df = spark.createDataFrame(rows, "id long, g string, score double").repartition(4)
    got = {r.kind: r for r in topn.skipping(df, 3, "g", "score", ["id"], ["id"], 500).collect()}
    assert got["bundle"].row_groups == got["bundle"].row_groups_read and got["bundle"].rows == 1000
    assert got["slice"].rows == 30_000 and got["slice"].row_groups >= 60 and got["slice"].row_groups_read <= 6
    best = topn.top_n(df, 3, "g", "score", ["id"], ["id"], 500).where("g = 'hot'").orderBy("place").collect()
    assert [(r.score, r.id) for r in best] == [(976.0, 976 + 977 * k) for k in range(3)]


def test_the_best_copy_stands_though_a_row_group_ends_between_the_copies(spark):
    rows = [(5, "a", 2.0, 4), (1, "a", 1.0, 7), (2, "a", 1.0, 7), (3, "b", 9.0, 8)]
    df = spark.createDataFrame(rows, "id long, g string, score double, same int").coalesce(1)
    for n in (2, 3):
        for size in (1, 2, 3):
            got = topn.top_n(df, n, "g", "score", ["id"], ["same"], size).orderBy("g", "place").collect()
            assert [(r.g, r.id) for r in got] == [("a", 5), ("a", 1), ("b", 3)]


Q = "冬至夜漱桥村有塾师病自汗，脉弦细而呕逆，荻梅与蕨茱孰为君药？"
E = "A potter from the old village has ringing ears and takes the powder at dusk, which dries the dampness better?"


@pytest.mark.parametrize(
    "answer, question, want",
    [
        (None, Q, "empty"), ("", Q, "empty"), (" 　\n​", Q, "empty"), ("……", Q, "empty"), ("【空】", Q, "empty"), ("N/A", None, "empty"), ("<answer></answer>", Q, "empty"),
        ("荻梅", Q, None), ("味甘性平", Q, None), ("以荻梅五分入汤，早晚各服一次即可", Q, None), ("1. 荻梅：化痰\n2. 蕨茱：止痒", Q, None),
        (Q, Q, "copied_question"), (f"问：{Q}", Q, "copied_question"), (f"您问的是：{Q}{Q}", Q, "copied_question"), (f"关于“{Q}”这个问题。", Q, "copied_question"), (f"{Q}荻梅", Q, None), (f"问：{Q}\n答：荻梅为君。", Q, None), (E, E, "copied_question"),
        ("所给证据不足，拒绝作答。", Q, "refusal"), ("抱歉，我不能提供用药建议，请咨询执业医师。", Q, "refusal"), ("抱歉，前一条有误，更正如下：君药是荻梅。", Q, None), ("此药无法久煎，须烊化。", Q, None), ("原文没有直接写明，不过同卷用荻梅一钱，可作依据。", Q, None), ("I'm sorry, but I cannot answer that from the passages provided.", E, "refusal"), (f"{Q}根据现有材料，无法回答这个问题。", Q, "refusal"),
        ("The formula warms the middle and should be taken with warm water.", Q, "other_language"), ("古い注釈によれば、梧根は黛葵よりも作用がおだやかである。", Q, "other_language"), ("君药为荻梅（Mororioides bulbalis），其功在固涩。", Q, None), ("方用荻梅一握，连服九日而愈。", E, "other_language"), ("Die Pflanze wird gewaschen und geschnitten, der Husten ließ nach.", E, "other_language"), ("at dusk", E, None),
        ("此案要点在于辨目赤与烦躁（见《素灯", Q, "truncated"), ("方用荻梅一握，蕨茱半两，", Q, "truncated"), ("凡肾虚之人，多见目赤，并且", Q, "truncated"), ("病家初不信，服药后大减。若误以为脾虚，用蕨", Q, "truncated"), ("The formula warms the middle. It should be taken with", E, "truncated"), ("上述医案中，以目赤为主……", Q, "truncated"), ("病家初不信，服药后大减[E1]。", Q, None), ("病家初不信，服药后大减。[E1, E2]", Q, None),
    ],
)
def test_defects(answer, question, want):
    assert defects.defect(answer, question) == want


# Refusals in phrasings that are not those of the test tables, and answers that must not be taken for any.
HELD_OUT = """很抱歉，这个问题我没有办法给您一个明确的答复。|对此我不便发表评论。|恕我无法就此作出判断。|现有材料里找不到与此相关的记载。|原文中并未提到这味药的用量。|我没能力回答这类专业问题，请咨询医生。|不好意思，这个我答不了。|由于缺乏足够的信息，暂时不能得出结论。
从所给文献看不出答案，资料不足。|此事我不敢妄下定论。|这类用药建议我不能提供，请遵医嘱。|对不起，本系统不会提供诊断建议。|所引段落没有涉及该方的出处。|依据不够充分，难以确定何者为君药。|我不知道。|这超出了我的知识范围。|此问题恕不作答。|目前没有线索可以说明这一点。|抱歉。我无法协助完成这个请求。|请另请高明。
I'm sorry, I can't help with that.|Unfortunately, I am unable to give medical advice.|The passages do not contain enough information to answer this.|There is no mention of the dose in the text.|I would rather not speculate on this point.|I don't have enough information to determine which herb is meant.|As an AI model, I can't provide a diagnosis.|It is not possible to say from the given evidence.|I'm afraid I cannot comment on that.|The source does not specify an amount.
I won't be able to respond to this question.|I have no idea.|Sorry, but I must decline to answer.|This is outside my area of expertise.|None of the excerpts address this question.|I am not qualified to advise on dosage; please consult a physician.|We could not determine the answer from the record.|I'd prefer not to discuss this topic.|Insufficient evidence to conclude.|I refuse to answer.
申し訳ありませんが、その質問にはお答えできません。|この点については判断しかねます。|資料に記載がないため、回答を控えます。|すみません、分かりません。|該当する情報は見つかりませんでした。|診断に関する助言は提供できません。
Das kann ich leider nicht beantworten.|Dazu liegen keine Informationen vor.|Je ne peux pas répondre à cette question.|No puedo responder a esa pregunta.""".replace("\n", "|").split("|")  # fmt: skip
SOUND = """此方不宜久服，服三剂即止。|病人不能平卧，夜间咳嗽加重。|无汗者用麻黄，有汗者用桂枝。|服后未见好转，遂加荻梅一钱。|本方主治脾虚，亦可用于气虚。|案中没有便秘，故不用大黄。|孕妇不可服用此药。|无力者加黄芪。|The patient could not sleep and took the powder at dusk.|The decoction should not be boiled for long.|It does not dry the throat, so it suits the elderly.
There is no fever in this case, and the pulse is thin.|Without ginger the formula is too cold.|この薬は妊婦には使えません。|痛みが取れないときは量を増やす。|未病先防，既病防变。|无毒，味甘，性平。|不作汤剂，只入丸散。|以荻梅为君，不用蕨茱。|The herb is not bitter.""".replace("\n", "|").split("|")  # fmt: skip


def test_refusals_not_seen_before():
    missed = [x for x in HELD_OUT if defects.diagnose(x, None)[0] != "refusal"]
    assert len(HELD_OUT) >= 50 and len(missed) <= 0.05 * len(HELD_OUT), missed
    assert not [x for x in SOUND if defects.diagnose(x, None)[0] == "refusal"]


def test_habits_tell_a_cut_answer_from_a_whole_one(spark):
    whole = [f"若证见{x}，可加荻梅一钱同煎服用。" for x in "头痛 咳嗽 口苦 目赤 便秘 自汗 耳鸣 腹冷".split()] * 30
    rows = [(i, x) for i, x in enumerate(whole)] + [(1000, "若证见头痛，可加荻梅一钱同煎"), (1001, "若证见口苦，可加荻"), (1002, "煎服甘平")]
    df = spark.createDataFrame([(i, None, x) for i, x in rows], "answer_id long, qa_id string, answer string")
    prompts = spark.createDataFrame([], "qa_id string, question string")
    assert sorted(tuple(r) for r in defects.defective(df, prompts).collect()) == [(1000, "truncated"), (1001, "truncated")]
    few = df.where("answer_id >= 1000")
    assert defects.defective(few, prompts).count() == 0  # nothing seen, nothing said


def test_observed_endings_against_brute_force():
    texts = ["甲乙，乙丙。", "乙丙", "丙x甲乙\n丁"]
    _, (keys, yes, last, n) = defects.observe(texts)
    got = {("c" + chr(k) if k < 1 << 21 else "t" + (chr(k >> 21) if k >> 21 > 1 else "") + chr(k & 0x1FFFFF)): (int(a), int(b), int(c)) for k, a, b, c in zip(keys.tolist(), yes, last, n)}
    want = defaultdict(lambda: [0, 0, 0])
    for t in texts:
        for i, c in enumerate(t):
            if c >= "\u2e80" and c not in "，。":
                for key in ("c" + c, "t" + (t[i - 1] if i else "") + c):
                    want[key][0] += i + 1 == len(t) or t[i + 1] in ",，。\n"
                    want[key][1] += i + 1 == len(t)
                    want[key][2] += 1
    folded = {k.replace("，", ","): tuple(v) for k, v in want.items()}
    assert got == folded


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=12), st.text("abcd", max_size=15), st.integers(1, 4))
def test_suffix_automaton_against_brute_force(prompt, response, least):
    marks = defects.SuffixAutomaton(prompt).copied(response, least)
    want = [any(lo <= i < hi and hi - lo >= least and response[lo:hi] in prompt for lo in range(len(response)) for hi in range(lo + 1, len(response) + 1)) for i in range(len(response))]
    assert [bool(x) for x in marks] == want


def test_defective_table(spark):
    a = spark.createDataFrame([(1, "k", "", "z"), (1, "k", "", "z"), (2, "k", Q, "z"), (3, None, "荻梅", "z"), (4, "gone", None, "z"), (None, "k", "", "z")], "answer_id long, qa_id string, answer string, question string")
    p = spark.createDataFrame([("k", Q, 1), ("k", Q, 1), (None, Q, 1), ("n", None, 1)], "qa_id string, question string, question_version int")
    assert sorted(tuple(r) for r in defects.defective(a, p).collect()) == [(1, "empty"), (2, "copied_question"), (4, "empty")]
    assert defects.judge(a, p).count() == 4
    assert defects.judge(a.limit(0), p).count() == 0


def brute_components(edges):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for n in near:
        seen, todo = {n}, [n]
        while todo:
            for m in near[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        out[n] = min(seen)
    return out


def test_components_against_brute_force(spark):
    rng = random.Random(2)
    edges = [(f"n{rng.randrange(150):03}", f"n{rng.randrange(150):03}") for _ in range(90)] + [(f"p{i:02}", f"p{i + 1:02}") for i in range(40)] + [("star", f"s{i}") for i in range(300)] + [("loop", "loop")]
    df = spark.createDataFrame(edges + [(None, "x"), ("y", None)], "a string, b string")
    got = {r.node: r.component for r in splits.components(df, "a", "b", least=50).collect()}
    assert got == brute_components(edges)
    assert splits.components(df.limit(0), "a", "b").count() == 0


def test_splits(spark):
    rng = random.Random(9)
    rows = [(f"q{i}", rng.choice(["SD0 ", "ｓｄ０"]) if i % 10 == 0 else f"sd{rng.randrange(1, 400)}", rng.choice(["dev", "Test", None])) for i in range(2000)] + [("qn", None, "dev"), ("q1", "sd9999", "dev")]
    links = spark.createDataFrame([(f"SD{2 * i}", f"sd{2 * i + 1}", "x") for i in range(1, 60)] + [("sd5", "sd5", "x"), (None, "sd1", "x")], "source_doc_id string, linked_doc_id string, component string")
    pairs = spark.createDataFrame(rows, "qa_id string, source_doc_id string, split string")
    plan = spark.createDataFrame([("train_pool", 0.8), ("dev", 0.1), ("test", 0.1)], "split string, share double")
    got = splits.assign_splits(pairs, links, plan).collect()
    assert len(got) == len(rows) and all(r.new_split for r in got)
    by = defaultdict(set)
    for r in got:
        by[r.component or r.qa_id].add(r.new_split)
    assert all(len(s) == 1 for s in by.values())
    share = Counter(r.new_split for r in got)
    assert abs(share["train_pool"] / len(rows) - 0.8) < 0.06 and abs(share["dev"] / len(rows) - 0.1) < 0.04
    assert all(abs(share[s] / len(rows) - w) < 0.01 for s, w in (("train_pool", 0.8), ("dev", 0.1), ("test", 0.1)))
    # a tenth more records, some of new and some of old documents, moves no record that has its split
    new = [(f"n{i}", f"sd{rng.randrange(300, 600)}", None) for i in range(200)]
    more = spark.createDataFrame(rows + new, "qa_id string, source_doc_id string, split string")
    held = spark.createDataFrame([(r.qa_id, r.new_split) for r in got], "qa_id string, new_split string")
    was = {(r.qa_id, r.source_doc_id): r.new_split for r in got}
    again = splits.assign_splits(more, links, plan, held=held).collect()
    assert len(again) == len(rows) + 200 and all(was.get((r.qa_id, r.source_doc_id), r.new_split) == r.new_split for r in again)
    share = Counter(r.new_split for r in again)
    assert all(abs(share[s] / len(again) - w) < 0.01 for s, w in (("train_pool", 0.8), ("dev", 0.1), ("test", 0.1)))
    docs = spark.createDataFrame([("sd0",), ("sd2",), ("sd3",), ("sd3",)], "source_doc_id string")
    p = spark.createDataFrame([("a", "SD2", "dev"), ("b", "ｓｄ３", "test "), ("c", "sd0", "dev"), ("d", "sd0", None)], "qa_id string, source_doc_id string, split string")
    assert sorted(r[0] for r in splits.broken_documents(p, links, docs).collect()) == ["sd2", "sd3"]
    assert splits.assign_splits(pairs.limit(0), links.limit(0), plan).count() == 0


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def mutated(rng, text, k, alphabet):
    t = list(text)
    for _ in range(k):
        i = rng.randrange(len(t) + 1)
        kind = rng.randrange(3)
        if kind == 0 or not t:
            t.insert(i, rng.choice(alphabet))
        elif kind == 1:
            del t[min(i, len(t) - 1)]
        else:
            t[min(i, len(t) - 1)] = rng.choice(alphabet)
    return "".join(t)


def test_overlap_against_brute_force(spark):
    rng = random.Random(11)
    han, latin = "".join(chr(0x4E00 + 7 * i) for i in range(60)), "abcdefghij"
    rows = []
    for n in (1, 2, 4, 5, 7, 9, 10, 12, 15, 19, 24, 40, 70, 90, 150):
        for alphabet in (han, latin):
            for _ in range(3):
                base = "".join(rng.choices(alphabet, k=n))
                for split in ("train_pool", "dev", "TEST "):
                    for e in {0, n // 5, n // 5 + 1, n // 10}:
                        rows.append((f"q{len(rows):04}", split, "sd1", mutated(rng, base, e, alphabet)))
    rows += [("qx", "dev", None, None), ("qy", "train_pool", None, " ，。"), ("qz", None, None, rows[0][3]), (None, "dev", "s", rows[0][3]), ("q0000", "dev", "s", rows[0][3]), ("w1", "train_pool", "s", "ＡＢ，c d E f g h"), ("w2", "dev", "s", "abcdefgh")]
    base = "".join(rng.choices(han, k=1500))
    rows += [("l1", "train_pool", "s", base), ("l2", "dev", "s", mutated(rng, base, 290, han)), ("l3", "dev", "s", mutated(rng, base, 320, latin) + "a" * 400), ("l4", "test", "s", base[:1250])]
    rows += rows[:5]
    df = spark.createDataFrame([(*r, 3) for r in rows], "qa_id string, split string, source_doc_id string, question string, text int")
    fold = lambda s: "".join(c for c in unicodedata.normalize("NFKC", s or "").lower() if unicodedata.category(c)[0] in "LN")
    side = lambda s: {"train_pool": 0, "dev": 1, "test": 1}.get((s or "").strip().lower())
    train = {(q, fold(t)) for q, s, _, t in rows if q and side(s) == 0 and fold(t)}
    evals = {(q, fold(t)) for q, s, _, t in rows if q and side(s) == 1 and fold(t)}
    want = {tuple(sorted((a, b))) for (a, x), (b, y) in itertools.product(train, evals) if a != b and abs(len(x) - len(y)) * 5 <= max(len(x), len(y)) and 5 * levenshtein(x, y) <= max(len(x), len(y))}
    got = {tuple(r) for r in overlap.found_pairs(df).collect()}
    assert got == want and len(want) > 300
    members = overlap.overlap_members(df).collect()
    assert {r.qa_id for r in members if r.links and r.split == "train_pool"} <= {q for p in want for q in p} | {q for q, _ in train & evals} and all(r.links == 0 or r.text for r in members)
    by = defaultdict(set)
    for r in members:
        by[r.split == "train_pool", r.text].add(r.qa_id)
    classes = overlap.overlap_classes(df).collect()
    assert {tuple(sorted((a, b))) for c in classes for a in by[True, c.train_text] for b in by[False, c.eval_text] if a != b} == want
    counts = overlap.overlap_counts(df).agg(F.sum("same"), F.sum("near"), F.sum("records")).first()
    assert counts[0] > 0 and counts[1] > 0 and counts[2] == len({q for q, _ in evals})
    assert overlap.found_pairs(df.limit(0)).count() == 0


def test_hot_terms_are_salted(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(overlap, "HOT_TERM", 3)
    grams, ids = np.array([[5, 5 << 46], [7, 5]], dtype=np.uint64), np.array([0, 1], dtype=np.int64)
    cells = np.zeros(1 << overlap.CELL_BITS, dtype=np.float32)
    cells[5] = 7
    index, once = overlap._salted(grams, cells, ids, True)
    probes, times = overlap._salted(grams, cells, ids, False)
    assert list(times) == [1, 3, 1, 1] and list(once) == [1] * 4 and set(index) <= set(probes) and len(set(probes[1:4])) == 3
    rows = [(f"q{i}", ("train_pool", "dev")[i % 2], f"今日天气甚好宜出门采药归来煎服第{chr(0x4E00 + i)}次记之") for i in range(40)]
    df = spark.createDataFrame(rows, "qa_id string, split string, question string").withColumn("source_doc_id", F.lit("d"))
    assert overlap.found_pairs(df).count() == 400


def test_dots_against_brute_force():
    import numpy as np

    rng = random.Random(3)
    weights = np.random.default_rng(3).uniform(0.5, 3, 1 << overlap.CELL_BITS)
    a, b = (["".join(rng.choices("abcd", k=rng.randrange(0, 30))) for _ in range(60)] for _ in range(2))
    a, b = zip(*[(x, y) for x, y in zip(a, b) if x or y])
    for x, y, *got in zip(a, b, *overlap.exact_dots(list(a), list(b), weights)):
        x, y = (x, y) if len(x) >= len(y) else (y, x)
        q = overlap.term_length(len(x))
        w = lambda t: weights[int(overlap._grams(np.array([[ord(c) for c in t]], dtype=np.uint64), q)[0, 0]) >> (64 - overlap.CELL_BITS)]
        u, v = (Counter(t[i : i + q] for i in range(len(t) - q + 1)) for t in (x, y))
        heavy = sorted((w(t) for t in u.elements()), reverse=True)
        dot = sum(w(t) * n for t, n in (u & v).items())
        norm = math.sqrt(sum(heavy) * sum(w(t) * n for t, n in v.items()))
        assert np.allclose(got, [dot, sum(heavy[q * (len(x) // 5) :]), dot / norm if norm else 0])


def test_a_question_of_one_character_forty_thousand_times(spark):
    import numpy as np

    around = overlap._sides(np.full((1, 40_000), ord("甲"), dtype=np.uint64), np.array([[0, 20_000, 39_998]]), 2)
    # ones counted on the left and right of a term: none, then as many as are told apart
    ones = [[sum(bin(int(w[i]) & (1 << 64) - 1).count("1") for w in around[half : half + 4]) for i in range(3)] for half in (0, 4)]
    assert ones == [[0, 8, 8], [8, 8, 0]]
    df = spark.createDataFrame([("a", "train_pool", "d", "今日天气甚好宜出门采药归来煎服"), ("b", "dev", "d", "今日天气甚好宜出门采药归来煎用"), ("c", "dev", "d", "甲" * 40_000)], "qa_id string, split string, source_doc_id string, question string")
    assert [sorted(r) for r in overlap.found_pairs(df).collect()] == [["a", "b"]]


def test_rarest_disjoint_windows_are_the_cheapest():
    import numpy as np

    rng = np.random.default_rng(1)
    for q, k, n in ((4, 2, 12), (3, 3, 11), (2, 4, 9)):
        cost = rng.integers(1, 50, size=(20, n - q + 1)).astype(np.float32)
        at = overlap.rarest_disjoint(cost, q, k)
        for row, picked in zip(cost, at):
            assert all(b - a >= q for a, b in zip(picked, picked[1:]))
            best = min(sum(row[list(c)]) for c in itertools.combinations(range(n - q + 1), k) if all(b - a >= q for a, b in zip(c, c[1:])))
            assert sum(row[picked]) == best


def test_token_tree_equals_encoding_at_once():
    enc = tokenize.encoder(tokenize.default_vocabulary())
    rng = random.Random(4)
    alphabet = "ab'sl  \n\t1２中文，。.!😀‍　é\x1ć<|endoftext|>"
    for _ in range(1500):
        x = "".join(rng.choices(alphabet, k=rng.randint(0, 80)))
        ids = enc.encode_ordinary(x)
        assert tokenize.encode(x, enc, leaf=rng.choice([1, 3, 9]), seam=rng.choice([1, 2, 8])) == ids
        assert tokenize.decode(ids, enc, 3) == x


def test_ordinary_documents_go_through_the_tree(monkeypatch):
    enc = tokenize.encoder(tokenize.default_vocabulary())
    joins = []
    joined = tokenize.join
    monkeypatch.setattr(tokenize, "join", lambda *a: joins.append(1) or joined(*a))
    text = (Q + E + "\n") * 4
    assert 256 < len(text) < 1024 and tokenize.encode(text, enc) == enc.encode_ordinary(text) and len(joins) >= 2
    joins.clear()
    assert tokenize.encode(Q, enc) == enc.encode_ordinary(Q) and not joins


def test_blocks_of_long_texts_are_joined_across_rows(spark):
    enc = tokenize.encoder(tokenize.default_vocabulary())
    rng = random.Random(14)
    alphabet = "ab'sl  \n\t1２中文，。.!😀\u200d　é<|endoftext|>"
    texts = ["".join(rng.choices(alphabet, k=n)) for n in (3, 16, 17, 40, 300, 700)] + ["a" * 650, " " * 333 + "x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(4, texts[4]), (4, texts[5]), (None, texts[4])], "doc_id long, text string")
    want = sorted((str(k), enc.encode_ordinary(t)) for k, t in [*enumerate(texts), (4, texts[4]), (4, texts[5]), (None, texts[4])])
    assert sorted((str(r.doc_id), list(r.ids)) for r in tokenize.token_ids(df, leaf=5, block=16).collect()) == want
    assert sorted((str(r.doc_id), r.n_tokens) for r in tokenize.token_counts(df, leaf=5, block=16).collect()) == sorted((k, len(x)) for k, x in want)


def test_token_ids_of_a_table(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "中文 text<|endoftext|>", 0), (3, "中文 text<|endoftext|>", 0), (None, "a", 0), (5, "长句。" * 30000, 0)], "doc_id long, text string, ids int")
    got = {}
    for r in tokenize.token_ids(df).collect():
        got.setdefault(r.doc_id, []).append(list(r.ids))
    enc = tokenize.encoder(tokenize.default_vocabulary())
    assert got[1] == [[]] and got[2] == [[]] and got[3] == [enc.encode_ordinary("中文 text<|endoftext|>")] * 2 and got[None] == [enc.encode_ordinary("a")]
    assert enc.decode(got[5][0]) == "长句。" * 30000
    assert tokenize.token_ids(df.limit(0)).count() == 0
    assert {r.n_tokens for r in tokenize.token_counts(df).where("doc_id < 3").collect()} == {0}


def test_plan_places_everything():
    rng = random.Random(6)
    for _ in range(100):
        h = {rng.randint(1, rng.choice([10, 300, 2048])): rng.choice([1, 2, 3, 1000]) for _ in range(rng.choice([1, 3, 60]))}
        got = Counter()
        for capacity, contents, n in packing.plan(h):
            assert capacity in packing.CAPACITIES and sum(s * k for s, k in contents) <= capacity
            for s, k in contents:
                got[s] += k * n
        assert got == h


def test_pack(spark):
    rng = random.Random(8)
    sizes = [(i, rng.choice([5, 7, 60, 700, 1500, 2048])) for i in range(900)] + [(1000, 5000), (1001, 4096), (1002, 0), (1003, None), (None, 9), (7, 7), (7, 7)]
    df = spark.createDataFrame([(*s, "x") for s in sizes], "doc_id long, n_tokens int, length string")
    rows = packing.pack(df).collect()
    held, lengths = defaultdict(list), Counter()
    for r in rows:
        lengths[r.doc_id] += r.n
        if r.container is not None:
            held[r.container].append((r.container_start, r.n, 2048))
            assert r.sequence_start % r.capacity == 0 and r.sequence_start <= r.container_start and r.container_start + r.n <= r.sequence_start + r.capacity
    want = Counter()
    for k, n in sizes:
        want[k] += n or 0
    assert lengths == want
    for places in held.values():
        places.sort()
        assert all(a + n <= b for (a, n, _), (b, _, _) in zip(places, places[1:])) and places[-1][0] + places[-1][1] <= places[0][2]
    assert sorted((r.part, r.item_start, r.n) for r in rows if r.doc_id == 1000) == [(0, 0, 2048), (1, 2048, 2048), (2, 4096, 904)]
    assert all(r.part == 0 for r in rows if r.doc_id not in (1000, 1001))
    assert [(r.container, r.n) for r in rows if r.doc_id in (1002, 1003)] == [(None, 0)] * 2
    usual = spark.createDataFrame([(i, max(1, int(rng.expovariate(1 / 250)))) for i in range(2000)], "doc_id long, n_tokens int")
    fill = packing.fill_report(packing.pack(usual)).collect()
    assert sum(r.unused for r in fill) < 0.02 * sum(r.tokens for r in fill)
    assert packing.pack(df.limit(0)).count() == 0
    joint, alone = packing.choices(usual).collect()
    assert len(fill) > 1 and joint.cost < 0.95 * alone.cost and abs(sum(r.cost for r in fill) - joint.cost) < 1e-6 * joint.cost
    with pytest.raises(ValueError):
        packing.pack(df, capacities=(500, 2048))


PROSE = "凡肝阴亏之人，多见目赤，舌红少苔。病家初不信，服药后大减，始复来诊。煎煮前应以清水浸泡半个时辰，宜后下。"
CASES = {
    "标签：涧蔻旗舰店,峦茱正品,峦梅生津,岭梅明目,紫皮,鸢檀,鹤皮批发,麂骨散寒,鸢胶温中,露萍": True,
    "https://a-b.test/p/1?id=3\nhttp://c.invalid/x\nhttps://www.d.example/t/5#top": True,
    "[蕨穗供应](https://w.test/t/7) | [雾茅求购](http://g.test/i/6) | [梧苓包邮](https://d.test/p/1)": True,
    "#哪里买 #润澄散 #十大品牌# #槿荆 #通络 #批发 #布澜膏 #蛟茅#": True,
    "【现货】涤曜膏 850g*4瓶 ￥316.0 顺丰\n【特惠】升旻饮 350g*1袋 ￥276.4 顺丰": True,
    "崖萍旗舰店碧蕊批发珏苏功效藜穗厂家皓桂哪里买潭根哪里买" * 6: True,
    "想买桐楝就选桐楝，功效认准桐楝，" * 12: True,
    "霁溪镇绛苏哪里买。漪湾绛苏批发。岑洲绛苏正品，樾溪镇绛苏旗舰店！岑溪镇绛苏包邮。岑山坊绛苏包邮；岑溪镇绛苏正品；枕湾绛苏哪里买；": True,
    PROSE: False,
    PROSE + "\n参见：https://x.test/n/308": False,
    "升旻汤\n霜荆9克，雾穗半两，溪薇七枚，露薷二两，珀藤一钱半，岫根半两，岚橘9克，鹤椿二两\n右8味，研末冲服。主治肾郁热。": False,
    "鹤霜本是峦蕊邻，\n藜蓟导滞肺经筠，\n琅蕊通络脾经石，\n鹤霜本是峦蕊邻，\n潭薷导滞胆经石。": False,
    "The formula warms the middle and should be taken with warm water. It opens the chest.\nKeywords: phlooriia, thwaufleyx, xanemniewa": False,
    "煎煮前, 应以清水浸泡. 卷5 肺湿困门, 右54味, 盐水炒, 日三服, 忌生冷. 主筋脉拘急, 除盗汗, 久服行气.": False,
}


@pytest.mark.parametrize("text, want", CASES.items())
def test_close_reading(text, want):
    bad, total = stuffing.stuffed(text)
    assert (bad > stuffing.SHARE * total) is want


def test_stuffed_pages(spark):
    rng = random.Random(3)
    sentence = ["凡肝阴亏之人，多见目赤。", "病家初不信，服药后大减。", "方用甘草三钱，连服九日而愈。", "此案要点在于辨先后，先者为本。", "孕妇慎用，宜减量。"]
    pages = [(i, "".join(rng.choices(sentence, k=6)), "x") for i in range(60)]
    pages += [(100 + i, t, "x") for i, t in enumerate(CASES)] + [(100, list(CASES)[0], "x"), (900, None, "x"), (901, "", "x"), (902, " \n", "x"), (None, "a", "x")]
    df = spark.createDataFrame(pages, "doc_id long, text string, key string")
    got = {r[0] for r in stuffing.stuffed_pages(df).collect()}
    assert got == {100 + i for i, want in enumerate(CASES.values()) if want}
    assert stuffing.stuffed_pages(df.limit(0)).count() == 0
    assert stuffing.judged(df).count() == len({p[0] for p in pages if p[0] is not None and p[1]})
