"""Sentence boundaries across languages and scripts.

A pushdown automaton reads the marks of a block of text: opening quotations and brackets go on the stack, and a stop only
counts where no quotation or bracket is open. Below them lie the list levels: a list mark at the head of a line opens, goes
on or closes one by its indentation and kind, and every sentence comes out with its level. Abbreviations
are looked up backwards in a trie; every script brings its own stops.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values of the languages -------------------------------------------------------------------------------------
#: Never the end of a sentence, whatever follows.
ABBREVIATIONS = """
dr mr mrs ms prof rev capt col gen lt sgt hon pres gov sen rep mt ft fr messrs mme mlle
vs viz cf ca esp resp excl incl approx eg ie aka fig figs vol vols ed eds sect sec ch pp op est
jan feb mar apr jun jul aug sep sept oct nov dec
sr sra srta dra ud uds avda av bd pág pag núm ej env
hr nr str vgl evtl ggf inkl bzw abb bd kap zzgl tel geb gegr jh sog
ул просп пер пл стр рис гл им проф акад обл корп тел
δηλ αρ σελ δρ κος κα π.χ
डॉ श्री से.मी ሴ.ሜ ዶ/ር د أ
""".split()
#: End a sentence only before a capital (or, in text without capitals, before a word that does not go on).
AMBIGUOUS = "inc ltd co corp llc jr sr. etc usw p.m a.m ph.d u.s u.k b.c a.d г т.д т.п κ.λπ κ.ά u.a".split()
#: Not the end before a number.
NUMERIC = "no nos n nº art para par item ex line lines page pages eq tab табл № núm".split()
#: Written behind a day's number with a stop: German, Danish and Norwegian, Czech, Finnish, Hungarian, Turkish has none.
MONTHS = """
januar februar märz april mai juni juli august september oktober november dezember jänner feber
marts maj oktober december mars desember ledna února března dubna května června července srpna září října listopadu prosince
tammikuuta helmikuuta maaliskuuta huhtikuuta toukokuuta kesäkuuta heinäkuuta elokuuta syyskuuta lokakuuta marraskuuta joulukuuta
január február március április május június július augusztus szeptember október
""".split()
#: Words that go on after an abbreviation in text without capitals.
GOING_ON = "in on of at to for are is was by with and or from as the's has had will that which were".split()
#: What follows a firm's name, which may end in a mark: legal forms, and what firms call themselves.
COMPANY = """
Inc Ltd Llc Plc Corp Co Company Gmbh Ag Kg Sa Sarl Sas Spa Srl Bv Nv Ab As Oy Group Holding Holdings Partners Brothers Bros Sons
Foods Media Stores Store Shop Works Office Supply Guild Studios Records Music Games Books Press Magazine Systems Motors Industries Labs Services Bank Airlines Hotels
""".split()
#: Who speaks is told after a quotation by one of these.
SPEECH = """
said says asked asks shouted replied cried whispered answered added called wrote yelled remarked explained
sagte sagt fragte fragt rief antwortete erwiderte flüsterte erklärte schrieb meinte ergänzte
dit demanda demande répondit répond cria ajouta murmura expliqua écrivit lança
dijo dice preguntó pregunta respondió gritó añadió susurró explicó escribió
сказал сказала говорит спросил спросила ответил ответила крикнул крикнула добавил добавила прошептал объяснил
είπε ρώτησε απάντησε φώναξε ψιθύρισε πρόσθεσε
""".split()
#: What goes on after a closing quotation in scripts without capitals.
PARTICLES = ("と", "って", "という", "라고", "이라고", "고 ", "하고", "라는", "は", "が", "を", "の", "に", "で", "も")
# -----------------------------------------------------------------------------------------------------------------------

STOPS = "。！？｡．।॥۔؟։።፧᙮"
MARKS = ".!?…‼⁇⁈⁉"
PAIRS = {"“": "”", "„": "“", "«": "»", "‹": "›", "‘": "’", "‚": "‘", "「": "」", "『": "』", "《": "》", "〈": "〉", "【": "】", "(": ")", "[": "]", "（": "）", "［": "］", "{": "}", "”": "“"}
BRACKETS = set(")]）］}】")
CLOSERS = "”’»›)]」』）］】〉》"
ASCII_QUOTES = "\"'"
#: Two line breaks with nothing but white space between; a CR LF is one break.
BLOCK = re.compile(r"(?>\r\n|\r|\n)(?:[^\S\r\n]*+(?>\r\n|\r|\n))++\s*")
EVENT = re.compile("[" + re.escape(STOPS + MARKS + "".join(PAIRS) + "".join(PAIRS.values()) + ASCII_QUOTES) + r";;]|(?<=[฀-๿])[   ]+(?=[฀-๿])")
LIST_MARK = re.compile(r"(?:\(?\d{1,3}[.)]|\([A-Za-z0-9]{1,3}\)|[A-Za-z][.)]|[-*•–—·▪◦‣])")
EMOJI = "\U0001f000-\U0001faff☀-➿⬀-⯿️‍\U000e0020-\U000e007f"
TAIL_EMOJI = re.compile(rf"(?:\s*[{EMOJI}]+)+")
WORD_BEFORE = re.compile(r"[^\s(\[{“„«\"'‘（「,;:—–]*$")
NEXT_WORD = re.compile(r"[^\W\d_]+")
HOUR_ONLY = re.compile(r"(?:\S+\s+){0,2}\d{1,2}(?::\d\d)?\s+[ap]\.m")
GREEK = re.compile(r"[Ͱ-Ͽἀ-῿]")
SPEAKER = re.compile(r"(?:[A-Z][^\W\d_]*\.?\s+){1,4}(?:" + "|".join(SPEECH) + r")\b")
REPORT = re.compile(r"(?:" + "|".join(SPEECH) + r")\b", re.I)


def _trie(words: list[str]) -> dict:
    root: dict = {}
    for w in words:
        node = root
        for c in reversed(w):
            node = node.setdefault(c, {})
        node[""] = True
    return root


ABBREVIATION_TRIE, AMBIGUOUS_TRIE, NUMERIC_TRIE = _trie(ABBREVIATIONS), _trie(AMBIGUOUS), _trie(NUMERIC)


def _ends_in(trie: dict, text: str, end: int, low: int) -> bool:
    """Whether the word that ends at ``end`` (exclusive) is in the trie."""
    node, i = trie, end - 1
    while True:
        if "" in node and (i < low or not (text[i].isalnum() or text[i] in "./'’-")):
            return True
        if i < low:
            return False
        node = node.get(text[i].lower())
        if node is None:
            return False
        i -= 1


def _mark_kind(mark: str) -> tuple[str, int]:
    """Kind of a list mark ('1.', '(1)', 'a)', '-') and its place in the order, 0 where it has none."""
    core = mark.strip("().")
    if core.isdigit():
        return mark.replace(core, "1"), int(core)
    if core.isalpha() and len(core) == 1:
        return mark.replace(core, "A" if core.isupper() else "a"), ord(core.lower()) - 96
    return (mark.replace(core, "a") if core.isalnum() else mark), 0


class _Lists:
    """The open list levels of a text, outermost first: (indentation, kind, number of the last mark). They are the lower part
    of the automaton's stack and outlive blocks, for items may be parted by blank lines."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, str, int]] = []

    def at(self, text: str, start: int) -> int:
        """Meet the beginning of a sentence: open, continue or close levels. Returns the level of a marked sentence, else the
        number of levels that its line's indentation leaves open (0 for text at the margin)."""
        line = max(text.rfind("\n", 0, start), text.rfind("\r", 0, start)) + 1
        indent = start - line
        if text[line:start].strip():
            return len(self.levels)  # inside a line: still in the item
        m = LIST_MARK.match(text, start)
        if not m or m.end() < len(text) and not text[m.end()].isspace():
            while self.levels and indent <= self.levels[-1][0]:
                self.levels.pop()
            return len(self.levels)
        kind, number = _mark_kind(m[0])
        while self.levels and (indent < self.levels[-1][0] or indent == self.levels[-1][0] and kind != self.levels[-1][1] and any(k == kind for i, k, _ in self.levels[:-1] if i == indent)):
            self.levels.pop()
        if self.levels and self.levels[-1][:2] == (indent, kind):
            self.levels[-1] = (indent, kind, number)
        else:
            self.levels.append((indent, kind, number))
        return len(self.levels)


class _Block:
    """One block of a text, from ``low`` to ``high``. ``lists`` are the levels that the blocks before it left open."""

    def __init__(self, text: str, low: int, high: int, lists: _Lists | None = None) -> None:
        self.text, self.low, self.high = text, low, high
        self.lists = lists or _Lists()
        part = text[low:high]
        self.no_capitals = part == part.lower() and part != part.upper()
        self.last_close: dict[str, int] = {}
        self.last = {c: part.rfind(c) + low for c in {*PAIRS.values(), *ASCII_QUOTES} if c in part}

    def after(self, at: int) -> int:
        """The first position from ``at`` that is not white space."""
        text, high = self.text, self.high
        while at < high and text[at].isspace():
            at += 1
        return at

    def tail(self, at: int) -> int:
        """The end of the closing marks and emoji from ``at``."""
        text, high = self.text, self.high
        while at < high and (text[at] in CLOSERS or text[at] in MARKS or text[at] in STOPS or text[at] in ASCII_QUOTES and (at + 1 == high or text[at + 1].isspace())):
            at += 1
        m = TAIL_EMOJI.match(text, at, high)
        return m.end() if m else at

    def starts_big(self, at: int) -> bool:
        """Whether what begins at ``at`` looks like the beginning of a sentence: a capital, a name with a capital inside,
        a figure, an opening mark, or a letter of a script without capitals."""
        c = self.text[at]
        if c.islower():
            m = NEXT_WORD.match(self.text, at, self.high)
            return bool(m) and m[0] != m[0].lower()
        return True

    def dot(self, at: int, start: int) -> int:
        """The end of the sentence at the full stop ``at``, or 0."""
        text, high = self.text, self.high
        run = at + 1
        while run < high and text[run] == ".":
            run += 1
        if run - at > 1:
            return self.ellipsis(at, run, start)
        end = self.tail(run)
        nxt = self.after(end)
        if nxt >= high:
            return end
        follow, before = text[nxt], text[at - 1] if at > start else " "
        if LIST_MARK.fullmatch(text, start, run):
            return 0
        if end > run and text[end - 1] not in CLOSERS + ASCII_QUOTES + MARKS:
            return end  # emoji behind a stop
        if nxt == end:  # nothing between the stop and what follows
            if not (before.isalnum() or before in "%)°»”"):
                return 0
            if follow in "¿¡“„«「『（\"'":
                return end if before.isalpha() or before in "%)" or before.isdigit() else 0
            if not follow.isalpha() or follow.islower():
                return 0
            word = WORD_BEFORE.search(text, start, at)[0]
            if follow.isupper():
                two = text[nxt + 1] if nxt + 1 < high else " "
                if "." in word or "/" in word or "@" in word or two == "." or len(word) < 2:
                    return 0 if not word[-1:].isdigit() else end
                if _ends_in(ABBREVIATION_TRIE, text, at, start) or word == "Ph":
                    return 0
                return end if before.islower() or before.isdigit() or before in "%)" or two.islower() else 0
            if "ऀ" <= follow <= "෿" or "฀" <= follow <= "๿" or "ሀ" <= follow <= "᎟":
                return 0  # these scripts have stops of their own
            return end if len(word) >= 2 and not before.isascii() else 0
        if "฀" <= before <= "๿":
            return 0
        if before.isspace():
            return end if not follow.isdigit() else 0
        if _ends_in(AMBIGUOUS_TRIE, text, at, start):
            if HOUR_ONLY.fullmatch(text, start, at):
                return 0
            return self.may_end(nxt, end)
        if text[max(start, at - 2) : at].lower() == "st" and (at - 3 < start or not text[at - 3].isalnum()):
            words = text[start:at].split()
            street = len(words) > 1 and (words[-2][:1].isupper() and len(words) > 2 or self.no_capitals and len(words) > 2 and words[-3] == "on")
            return end if street and self.starts_big(nxt) or street and self.no_capitals else 0
        if _ends_in(ABBREVIATION_TRIE, text, at, start):
            return 0
        if _ends_in(NUMERIC_TRIE, text, at, start) and follow.isdigit():
            return 0
        word = WORD_BEFORE.search(text, start, at)[0]
        if len(word) == 1 and word.isalpha() or len(word) > 2 and word[-2] in ".-" and word[-1].isalpha():
            # an initial or a part of an abbreviation, but not a point of the compass
            compass = re.search(r"\d\s*°\s*$", text[start : at - 1])
            return end if compass else 0
        if word.isdigit() and len(word) <= 2:
            m = NEXT_WORD.match(text, nxt, high)
            if m and m[0].lower() in MONTHS:
                return 0
        if follow.islower() and word.isupper() and re.fullmatch(r"[IVXLC]+", word):
            return 0
        if follow in ",;:)":
            return 0
        return end

    def may_end(self, nxt: int, end: int) -> int:
        if self.text[nxt] in ",;:)":
            return 0
        if not self.no_capitals:
            return end if self.starts_big(nxt) else 0
        m = NEXT_WORD.match(self.text, nxt, self.high)
        return 0 if m and m[0] in GOING_ON else end

    def ellipsis(self, at: int, run: int, start: int) -> int:
        end = self.tail(run)
        nxt = self.after(end)
        if nxt >= self.high:
            return end
        follow = self.text[nxt]
        if at > start and self.text[at - 1].isspace() or follow in ",;:" or not (follow.isupper() or follow.islower() or nxt > end):
            return 0
        if follow.islower() and not self.starts_big(nxt):
            return end if self.no_capitals and len(self.text[start:at].split()) > 1 and nxt > end else 0
        if nxt == end:
            return end if follow.isupper() and at - start > 4 else 0
        return end

    def mark(self, at: int, start: int) -> int:
        """The end at a question or exclamation mark, or 0."""
        text, high = self.text, self.high
        run = at + 1
        while run < high and text[run] in MARKS + "？！":
            run += 1
        end = self.tail(run)
        nxt = self.after(end)
        if nxt >= high:
            return end
        follow = text[nxt]
        if follow in ",;:)،，、" or follow in "—–-" and nxt + 2 < high and text[nxt + 1].isspace() and text[nxt + 2 : nxt + 3].islower():
            return 0
        if nxt == end:
            return end if follow.isalpha() and not follow.islower() or follow in "¿¡“„«「『（\"'" or end > run else 0
        m = NEXT_WORD.match(text, nxt, high)
        if text[at] == "!" and m and m[0].capitalize() in COMPANY and self.one_word(start, at):
            return 0
        return end

    def closed(self, at: int, opened: int, standing: bool, start: int) -> int:
        """The end behind the closing mark ``at`` of what was opened at ``opened``, or 0."""
        text, high = self.text, self.high
        i = at - 1
        while i > opened and (text[i].isspace() or text[i] in CLOSERS):
            i -= 1
        if i <= opened or text[i] not in MARKS + STOPS:
            return 0
        end = self.tail(at + 1)
        nxt = self.after(end)
        if nxt >= high:
            return end
        follow, bracket = text[nxt], text[at] in BRACKETS
        if follow in ",.;:،，、!?" + STOPS or text.startswith(PARTICLES, nxt) and nxt == end:
            return 0
        if bracket:
            return end if standing else 0
        if text[i] == "." and i > opened and _ends_in(ABBREVIATION_TRIE, text, i, opened):
            return 0
        if REPORT.match(text, nxt, high) or SPEAKER.match(text, nxt, high):
            return 0
        if follow in "—–-" and not follow.isalpha():
            return 0
        if follow.islower() and not self.starts_big(nxt):
            return end if standing and text[i] == "." and self.no_capitals else 0
        if not follow.isupper() and follow.isalpha() and text[i] not in STOPS and nxt > end and not (follow > "぀"):
            return 0  # a script without capitals goes on behind the space
        if nxt == end and "가" <= follow <= "힣":
            return 0
        return end

    def spans(self) -> Iterator[tuple[int, int, int]]:
        """(begin, end, list level) of the sentences."""
        text, high = self.text, self.high
        start = self.after(self.low)
        level = self.lists.at(text, start) if start < high else 0
        stack: list[tuple[str, int, bool]] = []
        skip = start
        for m in EVENT.finditer(text, start, high):
            at, c = m.start(), m[0]
            if at < skip:
                continue
            end = 0
            if stack and c == stack[-1][0] and self.closes(c, at):
                _, opened, standing = stack.pop()
                if not stack:
                    end = self.closed(at, opened, standing, start)
            elif len(c) == 1 and c in ASCII_QUOTES:
                free = at == start or not (text[at - 1].isalnum())
                if free and at + 1 < high and not text[at + 1].isspace() and self.ascii_close(c, at):
                    stack.append((c, at, self.stands(start, at)))
            elif c in PAIRS and self.last.get(PAIRS[c], -1) > at and not (c == "”" and not (at == start or text[at - 1].isspace())):
                if not (c in "‘“" and stack and stack[-1][0] == c):
                    stack.append((PAIRS[c], at, self.stands(start, at)))
            elif any(c == s[0] for s in stack) and c not in ASCII_QUOTES:
                while stack.pop()[0] != c:
                    pass
            elif stack:
                continue
            elif c == ".":
                end = self.dot(at, start)
                if not end and text[at + 1 : at + 2] == ".":
                    skip = at + 2 + (text[at + 2 : at + 3] == ".")
            elif c == "…":
                run = at + 1
                while run < high and text[run] == "…":
                    run += 1
                end, skip = self.ellipsis(at, run, start), run
            elif c in STOPS:
                end = self.tail(at + 1)
                if self.after(end) < high and text[self.after(end)] in "，、,،":
                    end = 0
            elif c in ";;":
                if c != ";" or at > start and GREEK.match(text[at - 1]):
                    end = self.tail(at + 1)
            elif c in MARKS:
                end = self.mark(at, start)
            elif c[0] in "   ":
                end = at
            if end:
                yield start, end, level
                start = skip = self.after(end)
                stack = []
                level = self.lists.at(text, start) if start < high else 0
        while high > start and text[high - 1].isspace():
            high -= 1
        if high > start:
            yield start, high, level

    def one_word(self, start: int, at: int) -> bool:
        words = self.text[start:at].split()
        return len(words) == 1 or len(words) == 2 and bool(LIST_MARK.fullmatch(words[0]))

    def stands(self, start: int, at: int) -> bool:
        """Whether nothing but a list mark lies between the start of the sentence and ``at``."""
        head = self.text[start:at].strip()
        return not head or bool(LIST_MARK.fullmatch(head))

    def closes(self, c: str, at: int) -> bool:
        if c != "'" and c != "’":
            return True
        return at + 1 >= self.high or not self.text[at + 1].isalnum()

    def ascii_close(self, c: str, at: int) -> bool:
        """Whether a closing mark for the ASCII quote at ``at`` follows in the block."""
        if c == '"':
            return self.last.get(c, -1) > at
        if c not in self.last_close:
            i = self.text.rfind(c, self.low, self.high)
            while i >= 0 and not (self.closes(c, i) and i > self.low and not self.text[i - 1].isspace()):
                i = self.text.rfind(c, self.low, i)
            self.last_close[c] = i
        return self.last_close[c] > at


def leveled_sentences(text: str) -> list[tuple[int, int, int]]:
    """(begin, end, list level) of the sentences of a text in code points, in order, without white space at either end; the
    level is 0 outside lists."""
    out, low, lists = [], 0, _Lists()
    for m in BLOCK.finditer(text):
        out += _Block(text, low, m.start(), lists).spans()
        low = m.end()
    out += _Block(text, low, len(text), lists).spans()
    return out


def sentences(text: str) -> list[tuple[int, int]]:
    """``leveled_sentences`` without the levels."""
    return [(a, b) for a, b, _ in leveled_sentences(text)]


def sentence_spans(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sentence_no, begin_pos, end_pos, list_level, sentence) of every text, whole texts, in order.

    ``list_level`` tells how many lists are open about the sentence. Null, empty and blank texts give no row. One set of
    rows comes out for each row in, repeated keys included; other columns are left out. Nothing is shuffled.
    """
    names = [key, "sentence_no", "begin_pos", "end_pos", "list_level", "sentence"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, len(texts), 512):
                rows, no, begin, end, level, words = [], [], [], [], [], []
                for i, t in enumerate(texts.slice(at, 512).to_pylist(), at):
                    for k, (a, b, d) in enumerate(leveled_sentences(t), 1):
                        for col, v in zip((rows, no, begin, end, level, words), (i, k, a, b, d, t[a:b])):
                            col.append(v)
                arrays = (pa.array(c, k) for c, k in zip((no, begin, end, level, words), (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string())))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *arrays], names)

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key), F.col(text).alias("__text")).where("__text is not null and __text != ''")
    return rows.mapInArrow(run, f"`{key}` {kind}, sentence_no int, begin_pos bigint, end_pos bigint, list_level int, sentence string")
