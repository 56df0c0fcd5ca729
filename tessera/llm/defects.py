"""Defects of prompt and response pairs: empty, truncated, refusal, copied question, other language."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.skew import salted_join
from tessera.session import cut

# What stands for "no answer" once marks and blanks are gone.
PLACEHOLDERS = frozenset("空 无 答 略 答案 暂无 无答案 未填 未填写 待补 待填 同上 null none nil nan na undefined empty tbd todo answer a q noanswer unknown blank なし 未回答 無".split())

# What a refusal is made of. One says that something isn't or can't be done and what, in this order (in Japanese
# and Korean in the other), within a few characters of each other; cues of the third kind say it alone.
DECLINES = {
    "zh": (
        "无法 不能 不便 不方便 难以 无从 拒绝 不予 不作 不会 不可 不宜 没法 没办法 没有办法 恕 暂不 未能 不敢 不愿 不想 无力 不打算 谢绝 无权 不适合 做不到 没能力".split(),
        "回答 作答 答复 解答 回应 给出 提供 判断 确定 断定 评论 置评 讨论 谈论 透露 告知 奉告 解释 推断 推测 协助 帮助 效劳 从命 作出 结论 定论 答疑 应答 满足 指导 建议 答 说清".split(),
    ),
    "en": (
        "cannot|can't|can not|could not|couldn't|unable to|not able to|won't|will not|would not|wouldn't|decline to|declining to|refuse to|refrain from|rather not|prefer not to|not comfortable|not allowed to|not permitted to|not possible to|impossible to|no way to|not in a position to|not appropriate|not qualified to|not going to|hesitant to|must decline".split("|"),
        "answer respond reply provid give giving offer help assist comment discuss say tell determine confirm conclu advise advice advising recommend speculat address share disclose judge decid comply fulfil resolve explain verdict opinion".split(),
    ),
    "ja": ("答え 回答 提供 判断 説明 お伝え コメント お役 返答 対応 お力 断定 助言".split(), "できません できない できかね しかねます しかねる かねます られません られない 控え いたしません 致しません 立てません なれません 避け".split()),
    "de": ("kann nicht|können nicht|kann ich nicht|kann ich leider nicht|kann leider nicht|möchte nicht|darf nicht".split("|"), "beantwort antwort sagen geben helfen auskunft beurteil".split()),
    "fr": ("ne peux pas|ne peut pas|ne puis|ne saurais|ne suis pas en mesure|refuse de|impossible de".split("|"), "répondre fournir donner aider dire commenter".split()),
    "es": ("no puedo|no podemos|no es posible|me niego a|no sabría|no soy capaz".split("|"), "responder contestar proporcionar dar ayudar decir comentar".split()),
}
LACKS = {
    "zh": ("没有 未 无 缺乏 缺少 找不到 查不到 查无 未见 不见 不含 并无 尚无 不足".split(), "提及 提到 涉及 检索到 记载 依据 线索 相关 信息 资料 说明 答案 材料 证据 内容 写明 述及 论及 交代".split()),
    "zh2": ("证据 资料 材料 信息 依据 线索 文献 记载 原文 内容".split(), "不足 不够 欠缺 有限 缺乏 不充分 不完整 未提 未涉 没提 没有 未载 不详".split()),
    "en": (
        "not enough|insufficient|no |lack|lacks|lacking|without|nothing in|none of|does not|do not|doesn't|don't|did not|didn't|is not|isn't|are not|aren't|not ".split("|"),
        "information evidence mention context detail basis record passage contain cover state specif include indicate source material excerpt reference text found".split(),
    ),
    "ja": ("記載 情報 言及 記述 根拠 資料 該当".split(), "ありません ない 見当たり 不足 見つかり 見当たら ございません".split()),
    "de": ("keine|nicht genug|nicht genügend|fehlen".split("|"), "information angabe hinweis beleg antwort".split()),
}
ALONE = {
    "declines": "无可奉告 答不上来 回答不了 答不了 说不上来 暂且搁下 不展开了 另寻高明 另请高明 我不知道 我不清楚 不得而知 不知道答案 不清楚答案 超出我 超出了我 不在我 超过我 爱莫能助 帮不上 帮不了 另请专家 请另问|"
    "i don't know|i do not know|no idea|not sure what|beyond my|outside my|beyond the scope|outside the scope|out of scope|as a language model|as an ai|unanswered|no answer is given|no answer can be|leave this question|i'm not certain|わかりません|分かりません|分かりかね|わかりかね|存じません|keine ahnung|weiß ich nicht|je ne sais pas|no lo sé",
    "lacks": "请咨询 请向医师 请遵医嘱 前往正规医院 到医院就诊 及时就医 知识范围 与所问无关 咨询专业 咨询医生 咨询医师 咨询执业|please consult|consult a doctor|consult a physician|consult a qualified|seek medical|ask a doctor|ask a physician|see a doctor|医師にご相談|医師に相談|専門家に",
}
#: Characters between the two halves of a cue, at most, in scripts without and with spaces.
NEAR = {"zh": 7, "zh2": 7, "ja": 8, "en": 36, "de": 40, "fr": 30, "es": 30}
#: A sentence that goes on to answer in spite of what it regrets.
HOWEVER = re.compile(r"不过|但是|但从|但据|然而|可作依据|可知|更正如下|however|but the|but it|nevertheless|しかし|ただし|jedoch", re.I)

# Words by which a language shows itself.
STOPWORDS = {
    "en": "the a an of and to in is was were that it with for as on by at from which should who not be are this or their has had when while because only said how does do did what why",
    "de": "der die das und ist nicht ein eine einen einem einer zu den dem des mit von für auf im bei wird werden sich auch als nach wie aus sind war vor dass oder durch über zur zum",
    "fr": "le la les des et est une un dans pour que qui pas sur avec au aux ce cette il elle sont par ne du plus ou se en de été après selon être",
    "es": "el la los las y es una un en para que con por del al se no su como más pero fue son este esta lo ser de según",
    "it": "il lo la gli le e è una un in per che con non di del della dei si come più sono anche da al nel",
    "pt": "o a os as e é uma um em para que com por do da dos das não se como mais foi são no na ao",
    "ru": "и в не на что с по как это из у для от к но а он она было",
}
VOTES: dict[str, list[str]] = {}
for _lang, _words in STOPWORDS.items():
    for _w in _words.split():
        VOTES.setdefault(_w, []).append(_lang)

OPEN = {"(": ")", "（": "）", "[": "]", "【": "】", "《": "》", "〈": "〉", "“": "”", "「": "」", "『": "』", "〔": "〕", "{": "}"}
CLOSE = frozenset(OPEN.values())
END = "。．.！!？?"
DANGLING = re.compile(
    r"(?:并且|而且|但是|因为|因此|所以|以及|或者|如果|由于|原因在于|从而|其中|例如|比如|譬如|包括|首先|其次|此外|另外|至于|与此同时|然后|以便|不仅|虽然|即使|只有|只要|除非|关于|对于|根据|按照|为了|若|且|及|与|或|而|则|即|之|的|把|被|将|向|从|对|于|以|因|故"
    r"|\b(?:and|but|or|nor|because|which|that|who|whose|the|a|an|of|with|to|for|as|in|on|at|by|from|is|was|were|are|be|should|may|can|will|would|when|while|if|although|however|therefore|since|so|than|into|under|over|after|before|its|their|his|her|this|these|und|oder|der|die|das|mit|von|zu)"
    r"|(?:が|は|を|に|で|と|の|も|へ|から|まで|より|て|ので|ため))$",
    re.I,
)
FRAME = re.compile(r"关于|这个问题|这一问题|该问题|此问题|的问题|这一问|您问的是|你问的是|您的问题是|你的问题是|所问|题目|问题|提问|原题|请问|敢问|试问|问|答案|回答|答|曰|the question is|your question|you ask(?:ed)?|asked|question|answer|regarding|about|[qa](?![a-z])", re.I)
CITED = re.compile(r"(?:\s*[\[［【（(]\s*[Ee]?\d{1,3}(?:\s*[,，、]\s*[Ee]?\d{1,3})*\s*[\]］】）)])+")
ASIDE = re.compile(r"([。．.！!？?])\s*[（(\[【][^（）()\[\]【】]{0,20}[）)\]】]$")
BREAK = re.compile(r"(?<=[。！？!?])|(?<=[A-Za-z]\.)(?=\s|[^\x00-\x7f]|$)|\n")


class SuffixAutomaton:
    """All substrings of a prompt; built in time linear in its length."""

    def __init__(self, text: str) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link = [-1]
        self.len = [0]
        last = 0
        for c in text:
            cur = self._state(self.len[last] + 1, {}, 0)
            p = last
            while p != -1 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p != -1:
                q = self.next[p][c]
                if self.len[q] == self.len[p] + 1:
                    self.link[cur] = q
                else:
                    clone = self._state(self.len[p] + 1, dict(self.next[q]), self.link[q])
                    while p != -1 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def _state(self, length: int, out: dict[str, int], link: int) -> int:
        self.next.append(out)
        self.link.append(link)
        self.len.append(length)
        return len(self.len) - 1

    def copied(self, response: str, least: int) -> bytearray:
        """Marks the characters of a response that lie in a stretch of at least ``least`` characters of the prompt."""
        marks = bytearray(len(response))
        state = length = 0
        for i, c in enumerate(response):
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.len[state]
            if c in self.next[state]:
                state = self.next[state][c]
                length += 1
            else:
                length = 0
            if length >= least:
                lo = i + 1 - length
                marks[lo : i + 1] = b"\x01" * length
        return marks


def fold(text: str) -> str:
    return unicodedata.normalize("NFKC", text).lower()


INK = regex.compile(r"[\p{L}\p{N}]")
_NO_INK = regex.compile(r"[^\p{L}\p{N}]+")
APOLOGY = re.compile(r"(?:非常|很|十分|实在|真的)?(?:抱歉|对不起|不好意思|遗憾|sorry|imsorry|iamsorry|apologies|iapologize|申し訳ありません|申し訳ございません|すみません)+")


def bare(text: str) -> str:
    """Letters and digits of a text."""
    return _NO_INK.sub("", text)


def letters(text: str) -> tuple[str, list[int]]:
    """Letters and digits of a folded text, and where each stands."""
    at = [i for i, c in enumerate(text) if unicodedata.category(c)[0] in "LN"]
    return "".join(text[i] for i in at), at


_refusals = None


def refusal_automaton():
    """Aho-Corasick automaton over the parts of refusals; once a Python worker. A part stands for (kind, language, half)."""
    global _refusals
    if _refusals is None:
        import ahocorasick

        meanings: dict[str, set] = {}
        for kind, table in (("declines", DECLINES), ("lacks", LACKS)):
            for lang, halves in table.items():
                for half, words in enumerate(halves):
                    for w in words:
                        meanings.setdefault(w, set()).add((kind, lang, half))
        for kind, words in ALONE.items():
            for w in words.split("|")[0].split() + words.split("|")[1:]:
                meanings.setdefault(w, set()).add((kind, "", 2))
        _refusals = ahocorasick.Automaton()
        for w, m in meanings.items():
            _refusals.add_word(w, (len(w), tuple(sorted(m))))
        _refusals.make_automaton()
    return _refusals


def _cued(sentence: str) -> bool:
    """Whether a sentence holds a cue alone, or both halves of one near each other and in order."""
    open_at: dict[tuple[str, str], int] = {}
    for end, (size, meanings) in refusal_automaton().iter(sentence):
        for kind, lang, half in meanings:
            if half == 2:
                return True
            if half == 0:
                open_at[kind, lang] = end + 1
            elif (kind, lang) in open_at and 0 <= end + 1 - size - open_at[kind, lang] <= NEAR[lang]:
                return True
    return False


def refuses(text: str) -> bool:
    """Every sentence of a folded text declines or regrets, and none goes on to answer."""
    said = False
    text = text.replace("’", "'")
    for sentence in BREAK.split(text):
        if not INK.search(sentence):
            continue
        if not _cued(sentence):
            # an apology by itself says nothing either way
            if APOLOGY.fullmatch(bare(sentence)):
                continue
            return False
        if HOWEVER.search(sentence):
            return False
        said = True
    return said


_HAN, _KANA, _HANGUL = re.compile("[\u3400-\u4dbf\u4e00-\u9fff\U00020000-\U000323af]"), re.compile("[\u3041-\u30fa\u30fc-\u30ff]"), re.compile("[\uac00-\ud7a3]")
_SPACED = re.compile(r"[^\W\d_\u3040-\u30ff\u3400-\u9fff\uac00-\ud7a3]+")


def language(text: str) -> str | None:
    """Language of a text by script and by the votes of its stopwords; None where it doesn't show.

    Each Han character, and each word of another script, counts one; what the lesser script has are names and quotations.
    """
    han, kana, hangul = (len(rx.findall(text)) for rx in (_HAN, _KANA, _HANGUL))
    words = _SPACED.findall(text)
    if hangul > max(han, kana, len(words)):
        return "ko"
    if kana >= 3 and 6 * kana >= han and kana + han > len(words):
        return "ja"
    if han >= len(words) and han >= 2:
        return "zh"
    votes: dict[str, float] = {}
    for w in words:
        known = VOTES.get(w, ())
        for lang in known:
            votes[lang] = votes.get(lang, 0) + 1 / len(known)
    if not votes:
        return "latin" if len(words) >= 3 else None
    best = max(sorted(votes), key=votes.get)
    rest = sorted(votes.values())[:-1]
    return best if votes[best] >= 2 and (not rest or votes[best] > 1.3 * rest[-1]) else "latin"


def differ(a: str | None, b: str | None) -> bool:
    """Whether two languages surely differ; of two Latin ones both must be known."""
    if a is None or b is None or a == b:
        return False
    return not ("latin" in (a, b) and {a, b} & {"latin"} and ({a, b} - {"latin"}) <= set(STOPWORDS))


def open_delimiters(text: str) -> list[str]:
    """The stack of delimiters left open; closing ones without an opening one don't count."""
    stack: list[str] = []
    for c in text:
        if c in OPEN:
            stack.append(c)
        elif c in CLOSE:
            for k in range(len(stack) - 1, -1, -1):
                if OPEN[stack[k]] == c:
                    del stack[k:]
                    break
    return stack


def truncated(text: str) -> bool | None:
    """Whether a text stops in the midst: an open delimiter, a dangling word or mark, or an end without a mark after sentences
    that have theirs. None where an only sentence ends without a mark, which may be a whole answer or a cut one."""
    t = text.strip()
    bare = CITED.sub("", t).rstrip()
    if not bare:
        return False
    if open_delimiters(bare):
        return True
    aside = ASIDE.sub(r"\1", bare)
    if aside[-1] in END and not aside.endswith(("...", "。。。")):
        return False
    if re.search(r"(?:…|\.\.\.|。。。|[、，,；;：:—–-])$", aside):
        return True
    if DANGLING.search(fold(aside)):
        return True
    if aside[-1] in CLOSE or aside[-1] in "\"'”’":
        inner = aside.rstrip("".join(CLOSE) + "\"'”’")
        if inner and inner[-1] in END:
            return False
    return True if ended_before(text) else None


def ended_before(text: str) -> bool:
    """An earlier sentence of the text has its mark while the last one has none."""
    bare = ASIDE.sub(r"\1", CITED.sub("", text.strip()).rstrip())
    return bool(re.search(r"[。！？]|[A-Za-z]{2}[.!?]\s", bare[:-1]))


NUMBERED = re.compile(r"^\s*(?:\d{1,3}\s*[.、)）]|[（(]\d{1,3}[)）]|[-*•])\s*")
def opening(sentence: str) -> str:
    """What a kind of sentence is known by: its first two characters, or words where words are spaced."""
    bare = NUMBERED.sub("", sentence).strip()
    return bare[:2] if bare[:1] > "\u2e7f" else " ".join(bare.split(" ", 2)[:2])


#: What a share of few cases leans on: as if so many more had been seen, of which the given part ended.
LEAN = 5.0
PRIOR_OPENING, PRIOR_END = 0.5, 0.25


def habits_asked(sentence: str) -> list[str]:
    """The kinds of habit that tell whether a sentence without a mark is cut: its opening (o), unless it is a mere phrase, its
    last two characters (t) and its last one (c), each with what it is known by."""
    last = sentence.strip()
    keys = []
    if len(bare(last)) >= 10:
        keys += ["o" + opening(last), "t" + last[-2:]]
    if last and last[-1] > "\u2e7f":
        keys += ["t" + last[-2:], "c" + last[-1:]]
    return sorted(set(keys))


def _merge(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Keys once each, with the sums of their counts."""
    keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, *(np.bincount(at, np.concatenate([p[i] for p in parts]), len(keys)).astype(np.int64) for i in (1, 2, 3))


_inked = np.full(0x110000, 2, dtype=np.uint8)


def _is_ink(codes: np.ndarray) -> np.ndarray:
    out = _inked[codes]
    if (out == 2).any():
        for o in np.unique(codes[out == 2]):
            _inked[o] = unicodedata.category(chr(o))[0] in "LN"
        out = _inked[codes]
    return out == 1


def observe(texts: list[str]) -> tuple[dict[str, list[int]], tuple[np.ndarray, ...]]:
    """Of some texts: how often sentences with each opening have their mark and how often they stand; and for each character (code)
    and pair of characters (two codes, 21 bits each) of unspaced scripts, how often a clause or the text ends after it, how
    often the text does without a mark, and how often it stands."""
    opened: dict[str, list[int]] = {}
    plain = [CITED.sub("", fold(t)).strip() for t in texts]
    for t in plain:
        for sentence in BREAK.split(t):
            if INK.search(sentence):
                cell = opened.setdefault(opening(sentence), [0, 0])
                cell[0] += sentence.rstrip()[-1] in END
                cell[1] += 1
    # NUL stands for what is before a text's first character and behind its last one
    codes = np.frombuffer("\x00".join([*plain, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    ink = _is_ink(codes)
    at = np.flatnonzero(ink & (codes > 0x2E7F))
    ended, last = ~ink[at + 1], codes[at + 1] == 0
    before = np.where(at > 0, codes[np.maximum(at - 1, 0)], 0)
    before = np.where(before == 0, 1, before)  # so that a pair is never taken for a character
    return opened, _merge([(np.concatenate([codes[at], (before << 21 | codes[at])]), *(np.r_[x, x].astype(float) for x in (ended, last, np.ones(len(at)))))])


def _observed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    opened: dict[str, list[int]] = {}
    ends = []
    for batch in it:
        some, counts = observe([t for t in batch.column(0).to_pylist() if t])
        for k, (y, n) in some.items():
            cell = opened.setdefault(k, [0, 0])
            cell[0] += y
            cell[1] += n
        ends = [_merge([*ends, counts])]
    for keys, yes, last, n in ends:
        names = ["c" + chr(k) if k < 1 << 21 else "t" + (chr(k >> 21) if k >> 21 > 1 else "") + chr(k & 0x1FFFFF) for k in keys.tolist()]
        yield _habit_rows(names, yes, last, n)
    if opened:
        yield _habit_rows(["o" + k for k in opened], [c[0] for c in opened.values()], [0] * len(opened), [c[1] for c in opened.values()])


def _habit_rows(names, yes, last, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k.encode("utf-8", "replace").decode() for k in names], pa.string()), *[pa.array(x, pa.int64()) for x in (yes, last, n)]], names=["habit", "yes", "last", "n"])


def habits_of(texts: DataFrame, text: str) -> DataFrame:
    """(habit, yes, last, n): how often what each opening, character and pair of characters is known by ends, ends a text without
    a mark, and stands, in all texts."""
    return texts.select(text).mapInArrow(_observed, "habit string, yes long, last long, n long").groupBy("habit").agg(*[F.sum(c).alias(c) for c in ("yes", "last", "n")])


def _cut_short(pairs: DataFrame) -> DataFrame:
    """(id) of undecided answers, rows (id, habit, yes, last, n), that habits call cut: a sentence whose opening usually comes with a
    mark, unless its last characters end a clause wherever they stand; or last characters after which hardly any clause ends."""
    yes, last, n = (F.coalesce(c, F.lit(0)) for c in ("yes", "last", "n"))
    share = lambda k, yes, n, prior, name: F.max(F.when(F.substring("habit", 1, 1) == k, (yes + LEAN * prior) / (n + LEAN))).alias(name)
    # a cut answer's last pair ends that answer, so texts' ends don't show that the pair ends clauses
    each = pairs.groupBy("id").agg(share("o", yes, n, PRIOR_OPENING, "opens"), share("t", yes, n, PRIOR_END, "pair"), share("c", yes, n, PRIOR_END, "one"), share("t", yes - last, n - last, PRIOR_END, "pair_inside"))
    return each.where("(opens >= 0.8 and pair < 0.9) or (one < 0.03 and pair_inside < 0.3)").select("id")


@lru_cache(4)
def _automaton(prompt: str) -> SuffixAutomaton:
    """One automaton a prompt and task: its answers lie side by side."""
    return SuffixAutomaton(prompt)


UNDECIDED = "undecided"


@lru_cache(4)
def _prompt(question: str) -> tuple[str, int, str | None]:
    """Letters of a question, the least stretch of them that counts as copied, and its language."""
    folded = fold(question)
    plain = bare(folded)
    wide = sum(ord(c) > 0x2E7F for c in plain) * 2 > len(plain)
    return plain, 5 if wide else 16, language(folded)


def diagnose(answer: str | None, question: str | None) -> tuple[str | None, str]:
    """(defect or None, last sentence): "undecided" where only the habits of the corpus tell whether the last sentence is cut."""
    folded = fold(answer) if answer is not None else ""
    folded = re.sub(r"</?[a-z]{1,20}/?>", "", folded)
    text = bare(folded)
    if not text or text in PLACEHOLDERS:
        return "empty", ""
    rest = folded
    if question:
        prompt, least, _ = _prompt(question)
        if len(prompt) >= least and len(text) >= 0.6 * len(prompt):
            marks = _automaton(prompt).copied(text, least)
            n = sum(marks)
            if n >= 0.7 * len(prompt):
                _, at = letters(folded)
                left = [at[i] for i in range(len(text)) if not marks[i]]
                if not INK.search(FRAME.sub("", "".join(folded[i] for i in left))):
                    return "copied_question", ""
                after = max(at[i] for i in range(len(text)) if marks[i])
                rest = folded[after + 1 :].lstrip(" \t\r\n”\"'’」』》）)?？。.!！,，;；:：")
                rest = re.sub(r"^(?:答|答案|回答|answer|a)\s*[:：]\s*", "", rest)
                if not INK.search(rest):
                    return None, ""
    if refuses(rest):
        return "refusal", ""
    if question and differ(_prompt(question)[2], language(rest)):
        return "other_language", ""
    found = truncated(rest)
    last = [x for x in BREAK.split(CITED.sub("", rest)) if x.strip()]
    if found is None and last:
        return UNDECIDED, last[-1]
    return "truncated" if found else None, ""


def defect(answer: str | None, question: str | None) -> str | None:
    """The defect of one answer without knowledge of the corpus, or None."""
    found = diagnose(answer, question)[0]
    return None if found == UNDECIDED else found


def _judged(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        ids, answers, questions = (batch.column(i) for i in range(3))
        found = [diagnose(a, q) for a, q in zip(answers.to_pylist(), questions.to_pylist())]
        asked = [[k.encode("utf-8", "replace").decode() for k in habits_asked(last)] if d == UNDECIDED else None for d, last in found]
        yield pa.RecordBatch.from_arrays([ids, pa.array([d for d, _ in found], pa.string()), pa.array(asked, pa.list_(pa.string()))], names=["id", "defect", "habits"])


def judge(answers: DataFrame, prompts: DataFrame, answer_id: str = "answer_id", key: str = "qa_id", answer: str = "answer", question: str = "question") -> DataFrame:
    """(answer_id, defect): one row an answer, defect null where there is none.

    Defects: empty, truncated, refusal, copied_question, other_language; the first that holds in the order empty,
    copied_question, refusal, other_language, truncated. An only sentence without a mark at its end, of at least ten letters, may be
    cut or not; there alone the habits of all answers decide (``habits_of``), with shares that lean on a prior where little
    was seen, so in a small corpus fewer are called truncated. Answers exported again count once; where exports differ, the
    greatest text stands. A prompt that is missing, null or blank leaves the tests that need none. Of several prompts of a
    key the greatest (question_version, question) stands. Crowded keys are salted. Rows with a null answer_id are left out;
    an answer with a null key is judged without a prompt.
    """
    a = answers.where(F.col(answer_id).isNotNull()).groupBy(answer_id).agg(F.max(F.struct(F.coalesce(F.col(answer), F.lit("")).alias("text"), F.col(key).alias("key"))).alias("x")).select(F.col(answer_id).alias("id"), "x.text", "x.key")
    version = F.coalesce(F.col("question_version"), F.lit(0)) if "question_version" in prompts.columns else F.lit(0)
    p = prompts.where(F.col(key).isNotNull() & F.col(question).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max_by(question, F.struct(version, F.col(question))).alias("question"))
    pairs = salted_join(a, p, "key", F.col("id"), how="left").select("id", "text", "question").sortWithinPartitions("question")
    kind = answers.schema[answer_id].dataType.simpleString()
    first = cut(pairs.mapInArrow(_judged, f"id {kind}, defect string, habits array<string>"))  # no texts any more
    asked = first.where("habits is not null").select("id", F.explode("habits").alias("habit"))
    known = habits_of(answers.where(F.col(answer).isNotNull()), answer)
    short = _cut_short(salted_join(asked, known.hint("merge"), "habit", F.col("id"), how="left")).withColumn("cut", F.lit("truncated"))
    both = first.join(short.hint("merge"), "id", "left")
    return both.select(F.col("id").alias(answer_id), F.when(F.col("defect") == UNDECIDED, F.col("cut")).otherwise(F.col("defect")).alias("defect"))


def defective(answers: DataFrame, prompts: DataFrame) -> DataFrame:
    """(answer_id, defect) of the defective answers alone. Cases as for judge."""
    return judge(answers, prompts).where(F.col("defect").isNotNull())
