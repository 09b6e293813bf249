"""Main content of web pages, by minimum-cut labelling of lines.

A linear classifier, trained here on weakly labelled lines of a bounded sample of pages, gives each line a log-odds of being
boilerplate; it sees the line's words, its shape, and how many pages of its site carry the same line, counted over all
pages. These log-odds alone are the terminal capacities of a graph whose smoothness edges join neighbouring lines: weakly
across the page, strongly where lines look like items of one list. The minimum cut labels the lines.

The word lists below label lines of the training sample only (and the headings among them tell where a list begins); they
take no part in the cost of a line. All lines of a batch of pages are scored together, as arrays.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.skew import hot_of_counts, join_hot
from lodestone.session import cut

#: Pages of the training sample: a bound of the sample, not of labelling.
TRAIN_PAGES = 2000
#: Buckets of hashed words.
WORDS = 1 << 13
#: Steps of the training.
STEPS = 150
#: Weight in training of titles in lists of other pages against that of headings.
LISTED = 0.85
#: The log-odds of a line are held within this.
SURE = 6.0
#: Capacities of edges: between any neighbours, between lines two apart in a block, inside a list, over a blank line.
NEAR, NEXT_BUT_ONE, LIST, GAP = 0.35, 0.15, 5.0, 0.2
#: Pages that are scored together; bounds a worker's memory.
TOGETHER = 512

# --- fixed values: what the parts of a page around its text say, in six languages ---------------------------------------
LIST_HEADS = (
    r"(?i)^(recent posts|most read.*|most popular.*|don[’']t miss|people also ask|you may also like|you might also like|related (articles|posts|pages|questions|stories)|in this section|more from .{1,60}|popular on .{1,60}|trending.{0,30}|latest (news|posts|articles)|see also|read next|recommended.{0,30}"
    r"|das könnte sie auch interessieren|mehr zum thema|ähnliche artikel|meistgelesen|weitere artikel|lesen sie auch|à lire aussi|articles (liés|similaires|récents)|les plus lus|sur le même sujet|artículos relacionados|te puede interesar|lo más leído|también te puede.*|más leídos"
    r"|читайте также|похожие (статьи|материалы)|популярное|相关文章|推荐阅读|热门文章|猜你喜欢|最新文章)\s*:?$"
)
NOTICES = (
    r"(?i)(we use cookies|cookie settings|uses? cookies|needs cookies|cookies? (policy|to (make|remember|improve))|small text files help|storing of small files|data policy|your privacy matters|we care about your data|store data on your device|partners store|you agree to|by staying here you accept"
    r"|^get a (free )?quote|deals »$|^copyright (©|\(c\)|\d)|terms of use \||sign up for (our|the)|subscribe to our|enter your e-?mail|no spam|download our (free )?app|get (our|the) (free )?app|live chat|story continues|continue reading below|^advertisement$|^sponsored|^ad$"
    r"|rate this (answer|page|article)|found this helpful|was this (useful|helpful)|share this (page|post|article)|^follow us|tweet it|pin it|report this (post|page|answer)|log ?in to (post|reply|comment|vote)|^tags?: |^filed under |^posted in |^categor(y|ies): |text size|^copy link$|^(like|share|save|print|tweet|accept|reject|more options|functional|analytics|necessary|marketing|statistics|menu|back to top|skip to (main )?content|toggle navigation|search|close|ok|no thanks)$"
    r"|^page \d+ of \d+|^[\d,.]+ (comments?|replies|answers?|views|shares)$|previous\b.*\bnext\b|^©|^\(c\) \d|all rights reserved|all trademarks belong|powered by .+ cms|terms · privacy|privacy · |site ?map$|^last (edited|updated) |general information only and does not replace"
    r"|diese seite speichert|ablehnen\.?$|datenschutz ·|· datenschutz|^impressum|nach oben$|^teilen ·|^anzeige$|bitte anmelden|alle rechte vorbehalten|wir verwenden cookies|newsletter"
    r"|dépôt de traceurs|mentions légales|^partager ·|^publicité$|connectez-vous|tous droits réservés|nous utilisons des cookies|haut de page"
    r"|acepta nuestra política|aviso legal|^compartir ·|^publicidad$|inicie sesión|todos los derechos reservados|volver arriba|usamos cookies"
    r"|соглашаетесь с правилами|все права защищены|^реклама$|войдите, чтобы|^поделиться|карта сайта|наверх$|конфиденциальность ·"
    r"|使用条款|隐私政策|版权所有|登录后|^分享|改善体验|接受全部|^广告$|返回顶部|网站地图)"
)
MENU_WORDS = {*(
    "home contact about us news blog shop events search help forum guides topics gallery deals careers downloads faq register login log in my account products services jobs archive categories support sitemap "
    "startseite kontakt ratgeber über laden suche anmelden hilfe mein konto produkte termine accueil boutique actualités aide recherche guides nous connexion mon compte "
    "inicio tienda guías ayuda buscar contacto noticias mi cuenta entrar nosotros foro главная контакты магазин советы войти новости помощь поиск о нас "
    "首页 新闻 帮助 关于我们 商城 登录 指南 联系我们 我的账户"
).split()}
# -----------------------------------------------------------------------------------------------------------------------

CRUMBS = r"(?i)^[^>»›→:]{1,40}\s(>|»|›|→|::)\s.{1,80}$|^(home|start|startseite|accueil|inicio|главная|首页|index)\s*(>|»|›|/|::|→)"
LEADS_ON = r"(?i)(\[…\]|\[\.\.\.\]|(…|\.\.\.)\s*(read more|more|weiterlesen|lire la suite|leer más|далее|阅读更多|更多)\.?)\s*$"
BREAKS_OFF = r"(…|\.\.\.)\s*$"
INNER_STOP = r"[^.\s]{2}[.!?][\"”’»)]*\s+\S|…\s*\S|[。！？]."
PARTED = re.compile(r"\s+[|/·•]\s+|\s{2,}| [–-] ")
MENU_SHAPE = r"^[^|/·•]{1,28}?((\s+[|/·•]\s+|\s{2,}| [–-] )[^|/·•]{1,28}?){2,}$"
ENDED = r"[.!?。！？…:;][\"”’»)\]」]*\s*$"
OWN_LIST = r"^(\d{1,3}[.)]|[-*•–])\s+\S"
OWN_LIST_WORDS = r"^(\d{1,3}[.)]|[-*•–])\s+(\p{Ll}|.*\d)"
TABLE_ROW = r"^[^|]*\d[^|]*( \| [^|]+){1,8}$|^[^|]+( \| [^|]+){0,7} \| [^|]*\d[^|]*( \| [^|]+){0,7}$"
HAN = re.compile(r"[぀-鿿]")

#: Of a line: rate, site_pages, share, title_like, usual.
FACTS = ("rate", "site_pages", "share", "title_like", "usual")
#: Shape features of a line, by name.
SHAPE = (
    "one", "length", "ended", "crumbs", "menu", "breaks_off", "leads_on", "top", "bottom", "rate", "frequent", "somewhat", "small_site", "share", "title_like", "own_title", "capital_word", "own_list", "own_list_words",
    "table_row", "long", "few_words", "lower", "labels", "once", "repeated", "usual", "sentence_once", "sentence_repeated", "short_sentence", "few_lower", "said_widely", "short_break", "sentence_frequent", "plain_once",
)
AT = {name: i for i, name in enumerate(SHAPE)}
HEAD, ITEM, LABEL = 1, 2, 3


class Lines:
    """The lines of some pages that are not blank, as arrays: page, no (from 1), text, shape features, kinds."""

    def __init__(self, bodies: pa.Array, titles: pa.Array, facts: pa.Array) -> None:
        split = pc.split_pattern(bodies, "\n")
        every = pc.utf8_trim_whitespace(split.flatten())
        starts = split.offsets.to_numpy() - split.offsets[0].as_py()
        page = np.repeat(np.arange(len(split)), np.diff(starts))
        no = np.arange(len(every)) - starts[page] + 1
        total = np.diff(starts)[page] if len(page) else page
        keep = pc.not_equal(every, "").to_numpy(zero_copy_only=False)
        self.text = every.filter(pa.array(keep))
        self.page, self.no, total = page[keep], no[keep], total[keep]
        known = [np.zeros(len(every)), np.ones(len(every)), np.zeros(len(every)), np.zeros(len(every)), np.zeros(len(every))]
        if len(facts):
            at = starts[pc.list_parent_indices(facts).to_numpy(zero_copy_only=False)] + (rows := facts.flatten()).field("line_no").to_numpy(zero_copy_only=False) - 1
            for values, name in zip(known, FACTS):
                values[at] = rows.field(name).to_numpy(zero_copy_only=False)
        self._shapes(total, titles, *(v[keep] for v in known))

    def _has(self, pattern: str) -> np.ndarray:
        return pc.match_substring_regex(self.text, pattern).to_numpy(zero_copy_only=False)

    def _shapes(self, total: np.ndarray, titles: pa.Array, rate: np.ndarray, site_pages: np.ndarray, share: np.ndarray, title_like: np.ndarray, usual: np.ndarray) -> None:
        text, n = self.text, len(self.text)
        size = pc.utf8_length(text).to_numpy(zero_copy_only=False)
        words = pc.count_substring_regex(text, r"\S+").to_numpy(zero_copy_only=False)
        title_like = title_like.astype(bool)
        ended, leads = self._has(ENDED), self._has(LEADS_ON)
        # several sentences with an ellipsis at the end are a paragraph, unless it leads on
        off = self._has(BREAKS_OFF) & ~leads
        off[off] = ~pc.match_substring_regex(text.filter(pa.array(off)), INNER_STOP).to_numpy(zero_copy_only=False)
        digits = self._has(r"\d")
        # titles often carry the name of the site behind the page's own; a page's name stands above its text once
        names = [t.strip() if t else "" for t in titles.to_pylist()]
        lines = text.to_pylist()
        own = np.zeros(n, bool)
        for i, (p, s) in enumerate(zip(self.page.tolist(), lines)):
            t = names[p]
            if t and t.startswith(s) and (len(t) == len(s) or len(s) > 3 and len(t) - len(s) < 40):
                own[i] = True
        hits = np.flatnonzero(own)
        own[:] = False
        own[hits[np.unique(self.page[hits], return_index=True)[1]]] = True
        listed, listed_words = self._has(OWN_LIST), self._has(OWN_LIST_WORDS)
        table = self._has(TABLE_ROW) & (words > 2)
        lower = self._has(r"^\p{Ll}")
        marks = pc.count_substring_regex(text, r"[·»|]").to_numpy(zero_copy_only=False)
        capital = self._has(r"^\p{Lu}\p{L}*$") | self._has(r"^[\p{Lo}]{1,8}$")
        often = rate * site_pages
        once = often < 1.5
        repeated = np.where(title_like, 0, 1 - 1 / np.maximum(1.0, often))  # by count, whatever the size of the site
        # what looks like a title is repeated with other figures in it: that tells nothing
        frequent = (rate >= 0.2) & (site_pages >= 5) & ~title_like
        cut_off = off | leads
        sentence = ended & (size > 60) & ~cut_off
        usual = np.where(title_like, 0, usual)
        f = dict.fromkeys(SHAPE)
        f |= {"one": np.ones(n), "length": np.minimum(size, 400) / 100, "ended": ended, "crumbs": self._has(CRUMBS), "menu": self._has(MENU_SHAPE) & ~table, "breaks_off": off, "leads_on": leads}
        f |= {"top": self.no <= 4, "bottom": total - self.no <= 4, "rate": np.where((site_pages >= 4) & ~title_like, rate, 0), "frequent": frequent, "somewhat": (rate >= 0.08) & (site_pages >= 12) & ~title_like}
        f |= {"small_site": site_pages < 4, "share": share, "title_like": title_like, "own_title": own, "capital_word": capital, "own_list": listed & ~listed_words, "own_list_words": listed_words & ~cut_off & ~frequent}
        f |= {"table_row": table, "long": size > 120, "few_words": words <= 4, "lower": lower, "labels": (marks >= 2) & ~digits, "once": once, "repeated": repeated, "usual": usual}
        f |= {"sentence_once": sentence & (once | ~f["somewhat"] & (f["rate"] < 0.05)), "sentence_repeated": sentence * repeated, "short_sentence": ended & (size > 20) & ~cut_off & ~frequent}
        f |= {"few_lower": lower & (words <= 4) & ~title_like & ~ended, "said_widely": (ended & (size > 20) & ~cut_off & ~frequent) * np.minimum(1, 4 * share) * np.maximum(0, 1 - 3 * usual)}
        f |= {"short_break": cut_off & (size < 150), "sentence_frequent": ended & frequent, "plain_once": once & (size < 80) & ~ended & ~capital}
        self.head = self._has(LIST_HEADS)
        self.kind = np.zeros(n, np.int8)
        plain = ~(f["crumbs"] | table | listed | own)
        east = np.fromiter((bool(HAN.search(s)) for s in lines), bool, n) if n else np.zeros(0, bool)
        # a heading's shape: a few words, not a sentence
        item = plain & (cut_off | title_like | (size < 80) & ~ended & ((words >= 4) | (size >= 4) & east))
        self.kind[plain & ~item & (capital | f["menu"] & (words <= 4))] = LABEL
        self.kind[item] = ITEM
        self.kind[self.head] = HEAD
        # what stands by itself above a sentence or a list of the page's own is a heading
        item = self.kind == ITEM
        before = np.zeros(n, bool)
        before[1:] = item[:-1] & (self.page[1:] == self.page[:-1])
        above = np.zeros(n, bool)
        above[:-1] = (self.page[1:] == self.page[:-1]) & ((sentence | ended & (size > 20)) & ~frequent | listed_words)[1:]
        self.alone, self.plain = item & ~cut_off & ~before & above, item & ~cut_off & ~frequent
        self.x = np.stack([np.asarray(f[k], np.float32) for k in SHAPE], 1) if n else np.zeros((0, len(SHAPE)), np.float32)

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """(line, bucket) of every word, every two neighbouring words, and the two at either end; figures are made equal."""
        low = pc.utf8_lower(pc.replace_substring_regex(self.text, r"[0-9]+", "9"))
        lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.replace_substring_regex(low, r"([^\p{L}\p{M}\p{N}\s])", r" \1 ")))
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        line = np.repeat(np.arange(len(lists)), np.diff(offsets))
        words = coded.dictionary.to_pylist()
        h = np.array([_hash(w) for w in words], np.int64)[code] if len(code) else np.zeros(0, np.int64)
        parts = [(line, h % WORDS)]
        if len(h) > 1:
            inside = line[1:] == line[:-1]
            pair = (h[:-1] * 1_000_003 + h[1:]) % 2_147_483_647
            parts.append((line[:-1][inside], pair[inside] % WORDS))
            first, last = offsets[:-1], offsets[1:] - 1
            some = last > first
            rows = np.flatnonzero(some)
            parts += [(rows, (pair[first[some] - offsets[0]] * 31 + 7) % WORDS), (rows, (pair[last[some] - offsets[0] - 1] * 37 + 11) % WORDS)]
        east = {i: w for i, w in enumerate(words) if len(w) > 1 and HAN.search(w)}
        if east:
            # scripts without spaces: every two neighbouring characters
            buckets = {i: [_hash(w[k : k + 2]) % WORDS for k in range(len(w) - 1)] for i, w in east.items()}
            at = np.flatnonzero(np.isin(code, np.fromiter(east, np.int64)))
            parts.append((np.repeat(line[at], [len(buckets[c]) for c in code[at].tolist()]), np.array([b for c in code[at].tolist() for b in buckets[c]], np.int64)))
        return np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])

    def log_odds(self, weights: np.ndarray) -> np.ndarray:
        """The classifier's log-odds of boilerplate of every line, from shape and words."""
        n = len(self.text)
        line, bucket = self.grams()
        said = np.bincount(line, weights[len(SHAPE) + bucket], minlength=n) / np.sqrt(np.maximum(1, np.bincount(line, minlength=n)))
        return np.clip(self.x @ weights[: len(SHAPE)] + said, -SURE, SURE)

    def edges(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The smoothness edges (a, b, capacity) between lines of one page."""
        n, page, no, kind = len(self.text), self.page, self.no, self.kind
        a = np.flatnonzero(page[1:] == page[:-1]) if n else np.zeros(0, np.int64)
        gap = no[a + 1] - no[a] > 1
        same = (kind[a + 1] == ITEM) & ((kind[a] == ITEM) | (kind[a] == HEAD)) | (kind[a] == LABEL) & (kind[a + 1] == LABEL)
        w = np.where(same, LIST, np.where(gap, GAP, NEAR))
        c = np.flatnonzero((page[2:] == page[:-2]) & (no[2:] - no[:-2] == 2)) if n > 2 else np.zeros(0, np.int64)
        far = []
        for h in np.flatnonzero(kind == HEAD).tolist():
            # a list may have a notice between its head and its first item
            i = h + 1
            while i < n and page[i] == page[h] and kind[i] not in (HEAD, ITEM) and u[i] >= 2:
                i += 1
            if h + 1 < i < n and page[i] == page[h] and kind[i] == ITEM:
                far.append((h, i))
        heads = np.array(far, np.int64).reshape(-1, 2)
        ends = lambda k: np.concatenate([a + k, c + 2 * k, heads[:, k]])
        return ends(0), ends(1), np.concatenate([w, np.full(len(c), NEXT_BUT_ONE), np.full(len(heads), LIST)])

    def weak_labels(self) -> np.ndarray:
        """1 boilerplate, 0 own text, -1 unknown: lines whose look, words or frequency leave no doubt. Items in a row under the
        heading of a list are boilerplate like it; one that stands alone above a sentence or list of the page's own is a
        heading of its text."""
        x = lambda name: self.x[:, AT[name]]
        has = lambda name: x(name) > 0
        menu = np.fromiter((is_menu(s) for s in self.text.to_pylist()), bool, len(self.text))
        y = np.full(len(self.text), -1)
        # the later lines hold over those before
        y[has("few_lower") & has("once")] = 0
        y[has("title_like") & has("top") & ~has("short_break")] = 0
        y[has("ended") & (x("length") > 0.6) & has("once") & ~has("breaks_off") & ~has("leads_on")] = 0
        y[has("own_list_words") & (x("rate") < 0.05) & (x("repeated") < 0.7)] = 0
        y[has("table_row") | has("own_title")] = 0
        y[has("frequent") & ~has("table_row") & ~has("own_title")] = 1
        y[has("short_break")] = 1
        y[self._has(NOTICES) | self.head | menu | has("crumbs") & ~has("ended")] = 1
        kind, page, found = self.kind, self.page, y.copy()
        listed = False
        for i in range(len(y)):
            same = i > 0 and page[i] == page[i - 1]
            listed = kind[i] == HEAD or listed and same and kind[i] == ITEM
            if listed:
                found[i] = 1
            elif self.alone[i] and y[i] != 1 and y[i + 1] == 0:
                found[i] = 0
        return found


def is_menu(line: str) -> bool:
    """Whether a line names parts of the site: several short labels in a row, most of them common ones."""
    parts = [p.strip(" []•·") for p in PARTED.split(line.strip()) if p.strip(" []•·")]
    known = sum(all(w in MENU_WORDS for w in p.lower().split()) for p in parts)
    return len(parts) >= 3 and known >= 2 and max(map(len, parts)) <= 24 or len(parts) == 1 and known == 1


@lru_cache(maxsize=1 << 17)
def _hash(gram: str) -> int:
    return zlib.crc32(gram.encode()) & 0x7FFFFFFF


def train(x: np.ndarray, y: np.ndarray, plain: np.ndarray, rows: np.ndarray, cols: np.ndarray, seed: int = 7) -> np.ndarray:
    """Weights of a logistic classifier over shape and word features, from labelled lines: shapes, labels, whether the line is
    ``plain``, and the (row, bucket) pairs of the words. All zero where one of the labels is missing.

    Headings and the titles in lists of other pages read alike, and only their place tells them apart: such plain lines of
    both labels are given nearly equal weight, so that their place in the graph decides."""
    n, shapes = len(y), x.shape[1]
    weights = np.zeros(shapes + WORDS)
    if not 0 < y.sum() < n:
        return weights
    rng = np.random.RandomState(seed)
    # the words must not only repeat what the shapes say: shapes are dropped at random
    dense = (x * (rng.random_sample(x.shape) > 0.3)).astype(np.float64)
    dense[:, 0] = 1
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(rows, minlength=n)))
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / n
    if 0 < y[plain].sum() < plain.sum():
        balance[plain & (y == 1)] *= LISTED * balance[plain & (y == 0)].sum() / balance[plain & (y == 1)].sum()
    square = np.full(len(weights), 1e-8)
    scaled = scale[rows]
    for _ in range(STEPS):
        z = dense @ weights[:shapes] + np.bincount(rows, weights[shapes + cols], minlength=n) * scale
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * balance
        grad = np.concatenate([dense.T @ err, np.bincount(cols, err[rows] * scaled, minlength=WORDS)]) + 1e-5 * weights
        square += grad * grad
        weights -= 0.3 * grad / np.sqrt(square)
    return weights


def cut_graph(u: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Labels (True: source side, boilerplate) that minimise the costs of labels plus the capacities of cut edges.

    ``u`` is the cost of own text less that of boilerplate; edges (a, b) have capacity w >= 0. Nodes whose cost outweighs all
    their edges are settled first and pass their edges on as costs, which is exact, some rounds of it over all nodes at
    once; max-flow settles what is left.
    """
    u, n = u.astype(np.float64).copy(), len(u)
    label, open_ = np.zeros(n, bool), np.ones(n, bool)
    for _ in range(16):
        weight = np.bincount(a, w, n) + np.bincount(b, w, n)
        now = open_ & (np.abs(u) >= weight)
        if not now.any():
            break
        label[now] = u[now] > 0
        open_ &= ~now
        for p, q in ((a, b), (b, a)):
            e = now[p] & open_[q]
            u += np.bincount(q[e], np.where(label[p[e]], w[e], -w[e]), n)
        keep = open_[a] & open_[b]
        a, b, w = a[keep], b[keep], w[keep]
    left = np.flatnonzero(open_)
    if len(left):
        at = np.full(n, -1)
        at[left] = np.arange(len(left))
        label[left] = min_cut(u[left].tolist(), {}, zip(at[a].tolist(), at[b].tolist(), w.tolist()))
    return label


def min_cut(unary: list[float], edges: dict[tuple[int, int], float], more: Iterator[tuple[int, int, float]] = ()) -> list[bool]:
    """``cut_graph`` for few nodes. Two exact reductions shrink the graph: a node that outweighs its edges is settled, and a
    node with one edge that outweighs all else about it joins the node there. Max-flow labels the rest."""
    n = len(unary)
    u = list(unary)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for x, y, c in (*((p, q, c) for (p, q), c in edges.items()), *more):
        if x != y:
            near[x][y] = near[x].get(y, 0.0) + c
            near[y][x] = near[y].get(x, 0.0) + c
    label: list[bool | None] = [None] * n
    joined: list[tuple[int, int]] = []
    gone = [False] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if gone[i]:
            continue
        weight = sum(near[i].values())
        if abs(u[i]) >= weight:
            label[i], gone[i] = u[i] > 0, True
            for j, c in near[i].items():
                u[j] += c if label[i] else -c
                del near[j][i]
                queue.append(j)
            continue
        j, c = max(near[i].items(), key=lambda e: e[1])
        if 2 * c >= abs(u[i]) + weight:
            joined.append((i, j))
            gone[i] = True
            u[j] += u[i]
            del near[j][i]
            for k, d in near[i].items():
                if k != j:
                    del near[k][i]
                    near[j][k] = near[j].get(k, 0.0) + d
                    near[k][j] = near[k].get(j, 0.0) + d
                    queue.append(k)
            queue.append(j)
    for a, side in _max_flow([i for i in range(n) if not gone[i]], u, near).items():
        label[a] = side
    for i, j in reversed(joined):
        label[i] = label[j]
    return [bool(x) for x in label]


def _max_flow(part: list[int], u: list[float], cap: list[dict[int, float]]) -> dict[int, bool]:
    """Maximum flow from the nodes with positive cost to those with negative, by shortest augmenting paths searched from
    one source at a time. The nodes that a source with flow left reaches are its side of the cut; no path leaves them, so
    later searches pass them by. Searches end at the nearest sink, which on the nearly linear graph of a page is near."""
    source_side: set[int] = set()
    for s in part:
        while u[s] > 1e-9 and s not in source_side:
            before, queue, end = {s: s}, deque([s]), None
            while queue and end is None:
                x = queue.popleft()
                for y, c in cap[x].items():
                    if c > 1e-9 and y not in before and y not in source_side:
                        before[y] = x
                        if u[y] < -1e-9:
                            end = y
                            break
                        queue.append(y)
            if end is None:
                source_side |= before.keys()
                break
            path, y = [], end
            while y != s:
                path.append((before[y], y))
                y = before[y]
            flow = min(u[s], -u[end], *(cap[p][q] for p, q in path))
            u[s] -= flow
            u[end] += flow
            for p, q in path:
                cap[p][q] -= flow
                cap[q][p] = cap[q].get(p, 0.0) + flow
    return {a: a in source_side for a in part}


def _pages(df: DataFrame) -> DataFrame:
    """The latest record of every id with a body, with its site and, for each line, the hash of its form (figures made equal)
    and that of its pattern (names and model numbers left out too); null where the line is blank."""
    rows = df.select("id", "url", "title", "body", "crawl_ts").where("id is not null and body is not null and trim(body) != ''")
    last = rows.groupBy("id").agg(F.max(F.struct("crawl_ts", "body", "url", "title")).alias("r")).select("id", "r.body", "r.url", "r.title")
    forms = F.transform(F.split("body", "\n"), lambda s: _form(s))
    each = F.transform(forms, lambda s: F.when(s != "", F.struct(F.xxhash64(s).alias("form"), _pattern(s).alias("pattern"))))
    return last.withColumn("site", F.coalesce(F.regexp_extract("url", r"^[a-zA-Z]+://([^/]+)", 1), F.lit(""))).withColumn("forms", each)


def _form(c: F.Column) -> F.Column:
    return F.regexp_replace(F.trim(c), "[0-9]+", "9")


def _pattern(form: F.Column) -> F.Column:
    return F.xxhash64(F.regexp_replace(form, r"(?<=\s)\p{Lu}[\p{L}\p{M}9-]*", "X"))


def _line_facts(pages: DataFrame) -> DataFrame:
    """(id, facts array<struct<line_no, rate, site_pages, share, title_like, usual>>): for each line that is not blank, the
    share of its site's pages that carry it (figures made equal), the pages of the site, the share of all sites that carry
    it, whether it has the form of a page title of the collection, and the share of the pages of those sites that carry it.
    A page whose site is not known takes rate and pages from the site of five pages or more where the line's rate is
    largest, of those that carry it more than once; a line that no such site carries counts as on a page by itself.

    Counted over all pages; only hashes travel. A site, a line of a site, a line of many sites and a pattern may all be hot:
    their counts, which are there anyway, name the few that are joined by broadcast.
    """
    once = pages.select("site", F.explode(F.array_distinct(F.filter("forms", lambda x: x.isNotNull()))).alias("x"))
    per_site = cut(once.groupBy("site", F.col("x.form").alias("form")).agg(F.count(F.lit(1)).alias("n"), F.max("x.pattern").alias("pattern")))
    known = F.col("site") != ""
    site_pages = cut(pages.where(known).groupBy("site").agg(F.count(F.lit(1)).alias("site_pages")))
    rated = join_hot(per_site, site_pages, "site", "left", hot_of_counts(per_site.groupBy("site").agg(F.count(F.lit(1)).alias("rows")), "site", "rows"))
    rated = rated.withColumn("rate", F.when(known, F.col("n") / F.col("site_pages")))
    largest = F.max(F.when(known & (F.col("site_pages") >= 5) & (F.col("n") >= 2), F.struct("rate", "site_pages"))).alias("largest")
    usual = F.coalesce(F.sum(F.when(known, F.col("n"))) / F.sum("site_pages"), F.lit(0.0)).alias("usual")
    per_form = rated.groupBy("form").agg(F.count_if(known).alias("sites"), F.count(F.lit(1)).alias("rows"), usual, largest, F.max("pattern").alias("pattern"))
    all_sites = F.broadcast(site_pages.agg(F.count(F.lit(1)).alias("all_sites")))  # one row
    per_form = cut(per_form.crossJoin(all_sites).withColumn("share", F.coalesce(F.col("sites") / F.when(F.col("all_sites") > 0, F.col("all_sites")), F.lit(0.0))))
    # the page's own name is what stands before the site's
    own = F.regexp_replace("title", r"\s+(\||-|–|—|::|·|»)\s+[^|–—:·»-]{1,60}$", "")
    titles = pages.where("title is not null").select(_pattern(_form(own)).alias("pattern")).distinct().withColumn("title_like", F.lit(True))
    patterns = per_form.groupBy("pattern").agg(F.count(F.lit(1)).alias("forms"))
    hot_forms = hot_of_counts(per_form, "form", "rows")
    per_form = join_hot(per_form, titles, "pattern", "left", hot_of_counts(patterns, "pattern", "forms"))
    per_form = per_form.select("form", "share", "usual", F.col("largest.rate").alias("rate_there"), F.col("largest.site_pages").alias("pages_there"), F.coalesce("title_like", F.lit(False)).alias("title_like"))
    key = F.xxhash64("site", "form").alias("key")
    met = join_hot(rated.select("site", "form", "n", "rate", "site_pages"), per_form, "form", "inner", hot_forms)
    met = met.select(key, "n", F.coalesce("rate", "rate_there", F.lit(0.0)).alias("rate"), F.coalesce("site_pages", "pages_there", F.lit(1)).cast("bigint").alias("site_pages"), "share", "title_like", "usual")
    met = cut(met)
    lines = pages.select("id", "site", F.posexplode("forms").alias("pos", "x")).where("x is not null").select("id", (F.col("pos") + 1).alias("line_no"), F.xxhash64("site", "x.form").alias("key"))
    facts = join_hot(lines, met.drop("n"), "key", "inner", hot_of_counts(met, "key", "n"))
    return facts.groupBy("id").agg(F.collect_list(F.struct("line_no", *FACTS)).alias("facts"))


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Lines]]:
    """Parts of batches of (id, body, title, facts), with their lines."""
    for at in range(0, batch.num_rows, TOGETHER):
        part = batch.slice(at, TOGETHER)
        yield part, Lines(*(part.column(i) for i in (1, 2, 3)))


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weakly labelled lines of pages: label, shape, buckets of words."""
    for batch in batches:
        for _, lines in _slices(batch):
            y = lines.weak_labels()
            row, col = lines.grams()
            order = np.argsort(row, kind="stable")
            offsets = np.searchsorted(row[order], np.arange(len(y) + 1)).astype(np.int32)
            words = pa.ListArray.from_arrays(offsets, pa.array(col[order].astype(np.int32)))
            shape = pa.ListArray.from_arrays((np.arange(len(y) + 1) * len(SHAPE)).astype(np.int32), pa.array(lines.x.reshape(-1)))
            out = pa.RecordBatch.from_arrays([pa.array(y.astype(np.int32)), pa.array(lines.plain), shape, words], ["label", "plain", "shape", "words"])
            yield out.filter(pa.array(y >= 0))


def fit(rows: DataFrame, train_pages: int) -> np.ndarray:
    """The classifier's weights, from about ``train_pages`` pages (never more than twice as many) chosen by hash of the id:
    a share of the pages, so that no task sends more than its part of the sample; the limit is the proven bound. Features
    and labels are made of whole pages by the workers."""
    share = train_pages / max(1, rows.count())
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).limit(2 * train_pages)
    table = sample.mapInArrow(_samples, "label int, plain boolean, shape array<float>, words array<int>").toArrow().combine_chunks()
    if not table.num_rows:
        return np.zeros(len(SHAPE) + WORDS)
    x = table["shape"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(SHAPE))
    words = table["words"].combine_chunks()
    sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False)
    return train(x, table["label"].to_numpy(), table["plain"].to_numpy(), np.repeat(np.arange(len(sizes)), sizes), words.flatten().to_numpy(zero_copy_only=False).astype(np.int64))


def label_lines(df: DataFrame, train_pages: int = TRAIN_PAGES) -> DataFrame:
    """(id, line_no, line, own) of every line that is not blank, of the latest record of every id.

    ``own`` tells whether the line belongs to the page's own text. Lines are parted by newlines and numbered from 1, blank
    ones too; white space at their ends is left out. Null and blank bodies give no row; pages without a site in their url
    belong to none; rows with a null id are left out. The classifier is trained on about ``train_pages`` pages (see ``fit``);
    everything else sees all pages.
    """
    pages = cut(_pages(df))
    rows = cut(pages.select("id", "body", "title").join(_line_facts(pages), "id").select("id", "body", "title", "facts"))
    weights = fit(rows, train_pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, lines in _slices(batch):
                u = lines.log_odds(weights)
                side = cut_graph(u, *lines.edges(u))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(lines.page)), pa.array(lines.no.astype(np.int64)), lines.text, pa.array(~side)], ["id", "line_no", "line", "own"])

    return rows.mapInArrow(run, "id string, line_no bigint, line string, own boolean")


def main_text(df: DataFrame, train_pages: int = TRAIN_PAGES) -> DataFrame:
    """(id, text): the own lines of every page in order, joined by newlines; a page without any has no row."""
    kept = label_lines(df, train_pages).where("own").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return kept.select("id", F.array_join(F.col("l.line"), "\n").alias("text"))
