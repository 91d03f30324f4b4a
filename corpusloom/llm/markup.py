"""Markup residue: flat text blocks, their features, the trees that judge them, and the clean text.

A text is cut into flat blocks (lines; block-level tags begin a new one).  A block's features are its word count and link
density, those of its two neighbours, and the densities of delimiters and of shapes that look like them (SHAPES): none
of them is a construct of a markup as such.  Trees trained on the labelled table in ``markup_table`` combine them to
say which markups a block holds and which role it has; the clean text is written block by block from the roles, in one
notation for headings, lists, code, tables and formulas.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np

from . import markup_table, tree

KINDS = ("html", "markdown", "wiki", "latex")
DEPTH = 24  # of the trees: the table is small, and its look-alikes are told apart by few blocks each

# Element names of HTML that count as tags.
BLOCK_TAGS = (
    "address article aside blockquote body br center dd details div dl dt fieldset figcaption figure footer form "
    "frame h1 h2 h3 h4 h5 h6 head header hr html iframe li main nav noscript object ol option p pre section select "
    "summary table tbody td textarea tfoot th thead title tr ul"
).split()
INLINE_TAGS = (
    "a abbr acronym audio b bdi bdo big button caption cite code col colgroup data del dfn em embed font i img input ins "
    "kbd label link map mark meta meter nobr picture q ref references rp rt ruby s samp script small source span strike strong style "
    "sub sup svg template time track tt u var video wbr nowiki math"
).split()

_NAMES = "|".join(sorted(BLOCK_TAGS + INLINE_TAGS, key=len, reverse=True))
TAG = re.compile(rf"<(/?)({_NAMES})(?=[\s/>])([^<>]*)>", re.I)
CUT_TAG = re.compile(rf"</?(?:{_NAMES})(?:\s+[\w:-]+\s*=\s*(?:\"[^\"<>]*\"?|'[^'<>]*'?|[^\s<>]+))*\s*/?$|<!--|-->|<!DOCTYPE\b|<\?xml|<!\[CDATA\[", re.I | re.M)
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|([A-Za-z][A-Za-z0-9]{1,31}));")
COMMENT = re.compile(r"<!--.*?-->", re.S)
SCRIPT = re.compile(r"<(script|style)\b[^<>]*>.*?</\1\s*>", re.I | re.S)
PRE = re.compile(r"<pre\b[^<>]*>(.*?)</pre\s*>", re.I | re.S)

FENCE = re.compile(r"^[ \t]{0,3}(`{3,}|~{3,})([^\n`]*)$", re.M)
FENCE_LINE = re.compile(r"^[ \t]{0,3}(?:`{3,}|~{3,})[ \t]*[\w+-]*[ \t]*$", re.M)
TICKS = re.compile(r"(?<![`\\])(`{1,2})(?!`)([^`\n]+?)\1(?!`)")
MD_HEAD = re.compile(r"^ {0,3}(#{1,6})[ \t]+(\S.*?)[ \t]*#*[ \t]*$", re.M)
MD_BOLD = re.compile(r"(?<![*\\])(\*{2,3})(?=[^\s*])([^*\n]*?[^\s*])\1(?!\*)")
MD_UNDER = re.compile(r"(?<![\w\\])__(?=[^\s_])([^\n]*?[^\s_])__(?!\w)")
MD_STRIKE = re.compile(r"~~(?=[^\s~])([^~\n]*?[^\s~])~~")
MD_STUB = re.compile(r"(?<![\w*/ ])\*\*(?=[^\W\d])|(?<=[^\W\d])\*\*(?![\w*/ ])|(?:^|(?<=\s))\*\*(?=[^\W\d])|(?<=[^\W\d])\*\*(?=\s|$)", re.M)
MD_LINK = re.compile(r"(!?)\[([^\[\]\n]*)\]\(\s*<?([^()\s<>]*(?:\([^()\s]*\)[^()\s]*)*)>?(?:\s+[\"'(][^\n]*?[\"')])?\s*\)")
MD_REF = re.compile(r"(!?)\[([^\[\]\n]+)\]\[([^\[\]\n]*)\]")
MD_DEF = re.compile(r"^ {0,3}\[([^\[\]\n]+)\]:[ \t]*\S+[^\n]*$", re.M)
MD_QUOTE = re.compile(r"^ {0,3}((?:>[ \t]?)+)(?=\S)", re.M)
MD_RULE = re.compile(r"^[ \t]{0,3}(?:={3,}|-{3,}|(?:\*[ \t]*){3,}|_{3,})[ \t]*$", re.M)
MD_SPLIT = re.compile(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$|^[ \t]*\|[ \t]*:?-{2,}:?[ \t]*\|[ \t]*$", re.M)
MD_ROW = re.compile(r"^[ \t]*\|[^\n|]*\S[^\n|]*\|(?:[^\n]*\|)?[ \t]*$", re.M)
MD_TASK = re.compile(r"^[ \t]*[-*+][ \t]+\[[ xX]\][ \t]", re.M)
AUTOLINK = re.compile(r"<((?:https?|ftp|mailto):[^\s<>]+)>")

WIKI_LINK = re.compile(r"\[\[([^\[\]\n|]*)(?:\|([^\[\]\n]*))?\]\]")
WIKI_STUB = re.compile(r"(?<![\w)\]])\[\[(?=[^\W\d])|(?<=\w)\]\](?![\w(])")
WIKI_TEMPLATE = re.compile(r"(?<![\w}^_{$\\])\{\{[^\W\d][^{}\n]*(?:\{\{[^{}]*\}\}[^{}\n]*)*\}\}")
WIKI_OPEN = re.compile(r"(?<![\w}^_{$\\])\{\{(?=[^\W\d][\w ]*\|)|(?<=[^\s{}\\])\}\}(?=\s|$)(?<!\\)")
WIKI_QUOTES = re.compile(r"(?<!')('{2,3}|'{5})(?!')([^'\n]*(?:'[^'\n]+)*?)\1(?!')|(?<!')'''(?!')")
WIKI_HEAD = re.compile(r"^(={2,6})[ \t]*([^=\n][^\n]*?)[ \t]*\1[ \t]*$", re.M)
WIKI_TABLE = re.compile(r"^[ \t]*(?:\{\||\|\}|\|-)[^\n]*$", re.M)
WIKI_URL = re.compile(r"\[(?:https?:)?//[^\s\]\[]+(?:[ \t]+([^\]\n]*))?\]")
WIKI_WORD = re.compile(r"__(?:NO)?(?:TOC|EDITSECTION|INDEX)__|#(?:REDIRECT|WEITERLEITUNG)\b", re.I)

TEX_MATH = re.compile(r"\$\$(.+?)\$\$|\\\[(.+?)\\\]|\\\((.+?)\\\)|(?<![\\$\w])\$(?=[^\s$\d]|\d[^$\n ]*[\\^_=+])([^$\n]*?[^\s$\\])\$(?![\d$])", re.S)
TEX_ENV = re.compile(r"\\(?:begin|end)\{([A-Za-z]+\*?)\}")
TEX_COMMAND = re.compile(r"(?:(?<![\w:\\/.])\\([A-Za-z]{2,})\*?(?![\w\\:/.])|\\([A-Za-z]{2,})\*?(?=\{)|(?<![\w:\\/.])\\([A-Za-z]{2,})\*?(?=\[[^\]\n]*\]\{))")
TEX_DOLLARS = re.compile(r"\$\$|(?<!\\)\\[\[\]()](?![\w\\])")

DECOY = re.compile(r"\s[<>]=?\s|<[A-Z][A-Z0-9_]+>|(?<![{\\])\{[\w .-]+\}|\$\d|\b\w+_\w+|[A-Za-z]:\\|->|<-|=>|\w\[\d*\]|(?<=\w)\*(?!\*)|\s\*\s|\[sic\]|#\d|&(?=\s|[A-Z]\b)")
WORDS = re.compile(r"[^\W_]+")
CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")


def trigger_table(n: int) -> np.ndarray:
    t = np.zeros(n, bool)
    t[[ord(c) for c in "<>&\\$*_#`[]{}|=~"]] = True
    return t


def needs_look(text: str) -> bool:
    return any(c in text for c in "<>&\\$*_#`[]{}|=~") or "''" in text or "---" in text


def entities(text: str) -> list[re.Match]:
    return [m for m in ENTITY.finditer(text) if m[1] is None or m[1] + ";" in html.entities.html5]


def constructs(block: str, inside: str = "") -> tuple[int, int, int, int]:
    """How many constructs of each markup one block holds; inside names the code or table it lies in."""
    h = m = w = t = 0
    if inside == "code":
        return 0, 0, 0, 0
    if "&" in block and ";" in block:
        h += len(entities(block))
    if "<" in block or "-->" in block:
        h += sum(1 for _ in TAG.finditer(block)) + sum(1 for _ in CUT_TAG.finditer(block))
    plain = block
    if "\\" in block or "$" in block:
        t += sum(1 for x in TEX_MATH.finditer(block) if x[4] is None or re.search(r"[\\^_={}+<>*/|-]|^\s*[A-Za-z](?:\([^()]*\))?\s*$", x[4]))
        plain = TEX_MATH.sub(" ", block) if t else block
        t += sum(1 for _ in TEX_COMMAND.finditer(plain)) + sum(1 for _ in TEX_ENV.finditer(plain)) + sum(1 for _ in TEX_DOLLARS.finditer(plain))
    if "`" in plain:
        m += sum(1 for _ in TICKS.finditer(plain)) + sum(1 for _ in FENCE_LINE.finditer(plain))
        plain = TICKS.sub(" ", plain)
    elif "~" in plain:
        m += sum(1 for _ in FENCE_LINE.finditer(plain))
    if "*" in plain:
        n = sum(1 for _ in MD_BOLD.finditer(plain))
        m += n if n else sum(1 for _ in MD_STUB.finditer(plain))
        m += sum(1 for _ in MD_RULE.finditer(plain))
    if "__" in plain:
        m += sum(1 for x in MD_UNDER.finditer(plain) if not re.fullmatch(r"[a-z0-9_]+", x[1]))
        w += sum(1 for _ in WIKI_WORD.finditer(plain))
    if "~~" in plain:
        m += sum(1 for _ in MD_STRIKE.finditer(plain))
    if "[" in plain:
        w += sum(1 for _ in WIKI_LINK.finditer(plain)) or sum(1 for _ in WIKI_STUB.finditer(plain))
        w += sum(1 for _ in WIKI_URL.finditer(plain))
        bare = WIKI_LINK.sub(" ", plain)
        m += sum(1 for _ in MD_LINK.finditer(bare)) + sum(1 for _ in MD_REF.finditer(bare)) + sum(1 for _ in MD_DEF.finditer(bare)) + sum(1 for _ in MD_TASK.finditer(bare))
    elif "]]" in plain:
        w += sum(1 for _ in WIKI_STUB.finditer(plain))
    if "{{" in plain or "}}" in plain:
        w += sum(1 for _ in WIKI_TEMPLATE.finditer(plain)) or (0 if t else sum(1 for _ in WIKI_OPEN.finditer(plain)))
    if "''" in plain:
        w += sum(1 for _ in WIKI_QUOTES.finditer(plain))
    if "==" in plain:
        n = sum(1 for _ in WIKI_HEAD.finditer(plain))
        w += n
        m += 0 if n else sum(1 for _ in MD_RULE.finditer(plain))
    if "#" in plain:
        m += sum(1 for _ in MD_HEAD.finditer(plain))
    if ">" in plain:
        m += sum(1 for _ in MD_QUOTE.finditer(plain)) + sum(1 for _ in AUTOLINK.finditer(plain))
    if "--" in plain:
        m += sum(1 for _ in MD_RULE.finditer(plain)) if "|" not in plain else sum(1 for _ in MD_SPLIT.finditer(plain))
    if "|" in plain:
        n = sum(1 for _ in WIKI_TABLE.finditer(plain))
        if not MD_SPLIT.search(plain):
            w += n
        if inside != "wikitable":
            m += sum(1 for _ in MD_ROW.finditer(plain))
    return h, m, w, t


# How lines of code begin or end that follow a fence nobody closed.
CODE_START = re.compile(
    r"\s*(?:(?:def|class|for|while|if|elif|else|try|except|with|return|let|const|var|import|from|function|public|private|static|async|await|fn|func|package|struct|enum|switch|case|do|end|done|fi|pass|break|continue|raise|throw|new)\b(?=$|.*[;:{}()=\[\],.\"'_\d]|\s+\w+$)"
    r"|(?:SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP|WITH|FROM|WHERE|GROUP BY|ORDER BY|JOIN|VALUES|SET|LIMIT)\b(?=$|.*[\w*)(,;])|#include\b|@\w+|\$ \S|>>> "
    r"|[\w.\[\]]+(?:, ?[\w.]+)*\s*[-+*/|&:]?=\s*\S|[\w.]+\([^\n]*\)\s*[;:{]?\s*$)"
)
CODE_SIGN = re.compile(r"^(?: {2,}|\t)\s*\S|[;{}\]]\s*$|\w\([^\n]*\)?\s*:?\s*$|[=!]=|->|=>|::|&&|\|\||\w\[\w*\]|^\s*(?:sudo|pip|npm|git|cd|ls|cat|echo|python|curl|docker|export)\s")
CODE_NEUTRAL = re.compile(r"\s*(?:$|#|//|--|/?\*)")
CODE_STRING = re.compile(r"\"[^\"\n]*\"|(?<![\w\s])'[^'\n]*'|(?<==\s)'[^'\n]*'")
SQL = re.compile(r"\s*[A-Z]{3,}\b")
PROSE = re.compile(r"(?<!\w)[^\W\d_]+(?:[ ,'’-]+[^\W\d_]+(?![\w(.\[])){3,}|[぀-ヿ㐀-鿿豈-﫿]{5,}|[^\W\d_]{2,}[ ,'’-]+[^\W\d_]{2,}[.!?…][\"”»)]?\s*$")
ITEM = re.compile(r"\s*(?:[-*+]|\d+[.)])\s")


def code_line(line: str, tagged: bool = False) -> bool:
    """Whether a line after an unclosed fence looks like code; tagged: the fence names a markup language."""
    if tagged and re.match(r"\s*[<\\]", line):
        return True
    bare = CODE_STRING.sub('""', line)
    if PROSE.search(bare) and not (SQL.match(bare) and CODE_START.match(bare)):
        return False
    if CODE_START.match(bare):
        return True
    if not CODE_SIGN.search(bare) or ITEM.match(line):
        return False
    h, _, w, t = constructs(line)
    return not (h or w or t)


def fences(text: str) -> list[tuple[int, int, int, int]]:
    """Start of each code fence, start and end of its code, end of the fence.  One that is never closed, or not before
    the next that names a language, is a remnant: only the lines after it that look like code are its code."""
    edges = [(m.start(), m.end(), m[1][0], len(m[1]), m[2].strip(" \t~")) for m in FENCE.finditer(text)]
    out: list[tuple[int, int, int, int]] = []
    never: dict[str, int] = {}  # shortest fence of each sign that no line closes
    i = 0
    while i < len(edges):
        start, end, sign, size, name = edges[i]
        i += 1
        if end == len(text):
            break
        close = None
        if size < never.get(sign, size + 1):
            for j in range(i, len(edges)):
                if edges[j][2] == sign and edges[j][3] >= size:
                    if not edges[j][4]:
                        close = j
                        break
                    if edges[j][3] == size:
                        break
            else:
                never[sign] = size
        if close is not None:
            out.append((start, end + 1, edges[close][0], edges[close][1]))
            i = close + 1
            continue
        tagged = name.split(" ")[0].lower() in ("html", "xml", "svg", "vue", "jsx", "tsx", "tex", "latex")
        stop = edges[i][0] if i < len(edges) else len(text)
        at = last = end + 1
        while at < stop:
            to = text.find("\n", at, stop) + 1 or stop
            line = text[at:to].rstrip("\n")
            if code_line(line, tagged):
                last = to
            elif not CODE_NEUTRAL.match(line):
                break
            at = to
        out.append((start, end + 1, last, last))
    return out


def flat_blocks(text: str) -> list[tuple[str, str]]:
    """The flat blocks of a text with what they lie in: '', 'code' or 'wikitable'."""
    out: list[tuple[str, str]] = []
    pos = 0
    code = [(a, b) for _, a, b, _ in fences(text)] if "```" in text or "~~~" in text else []
    for a, b in [*code, (len(text), len(text))]:
        for line in text[pos:a].split("\n"):
            if line.strip():
                out.append((line, ""))
        if b > a:
            out.append((text[a:b], "code"))
        pos = b
    depth = False
    for i, (line, inside) in enumerate(out):
        if inside:
            continue
        s = line.lstrip()
        depth = depth or s.startswith("{|")
        if depth:
            out[i] = (line, "wikitable")
        if s.startswith("|}"):
            depth = False
    return out


def _size(s: str) -> int:
    k = len(CJK.findall(s))
    return len(WORDS.findall(CJK.sub(" ", s))) + (k + 1) // 2


LINKS = re.compile(r"<a\b[^<>]*>(.*?)</a\s*>|\[\[(?:[^\[\]|]*\|)?([^\[\]]*)\]\]|(?<!!)\[([^\[\]]*)\]\([^()]*\)|\[https?://\S+\s+([^\]]*)\]|https?://\S+", re.I | re.S)

# Delimiters and shapes that are counted in a block, each with characters of which it needs one.
SHAPES = {
    "element name after an angle": ("<", rf"</?(?:{_NAMES})\b"),
    "angles around something": ("<", r"<[^<>\s][^<>]*>"),
    "element name cut off": ("<", rf"<(?:{_NAMES})\b[^<>]*$"),
    "slash at an angle": ("<>", r"</\w|/>"),
    "attribute": ("=", r"\s[\w:-]+\s*=\s*[\"']"),
    "capitals in angles": ("<", r"</?[A-Z][A-Z0-9_]+>"),
    "spaced angle": ("<>", r"(?:^|\s)[<>]=?(?=\s|$)"),
    "comment sign": ("<>", r"<!(?:--|\[|D)|-->|<\?xml"),
    "ampersand to semicolon": ("&", r"&#?[A-Za-z0-9]{2,31};"),
    "ampersand": ("&", r"&"),
    "hashes before a space": ("#", r"^ {0,3}#{1,6}[ \t]+\S"),
    "hash": ("#", r"#"),
    "stars at a word": ("*", r"(?<![\w*/ ])\*\*(?=[^\W\d])|(?<=[^\W\d])\*\*(?![\w*/ ])|(?:^|(?<=\s))\*\*(?=[^\s*])|(?<=[^\s*])\*\*(?=\s|$)"),
    "two stars": ("*", r"\*\*"),
    "star": ("*", r"\*"),
    "two underscores at a word": ("_", r"(?<![\w\\])__(?=[^\s_a-z])|(?<![\w\\])__(?=[a-z]+[^\w\n]+[^\n]*__)"),
    "underscore": ("_", r"_"),
    "two tildes": ("~", r"~~(?=[^\s~])[^~\n]*~~"),
    "ticks around something": ("`", r"(?<![`\\])(`{1,2})(?!`)([^`\n]+?)\1(?!`)"),
    "fence": ("`~", r"^[ \t]{0,3}(?:`{3,}|~{3,})"),
    "bracket": ("[", r"\["),
    "bracket to parenthesis": ("[", r"\]\("),
    "bracket to bracket": ("[", r"(?<!\w)\[[^\[\]\n]+\]\["),
    "figure in brackets": ("[", r"\w\[|\[\d*\]"),
    "bracket and colon": ("[", r"^ {0,3}\[[^\[\]\n]+\]:\s*\S"),
    "tick box": ("[", r"^[ \t]*[-*+][ \t]+\[[ xX]\][ \t]"),
    "two brackets before a word": ("[", r"(?<![\w)\]])\[\[(?=[^\s\d\[\]])"),
    "two brackets after a word": ("]", r"(?<=[\w)])\]\](?![\w(\[])"),
    "address in brackets": ("[", r"\[(?:https?:)?//[^\s\]\[]"),
    "braces before a name": ("{", r"(?<![\w}^_{$\\])\{\{(?=[^\W\d])"),
    "braces at an end": ("}", r"(?<=[^\s{}\\])\}\}(?![\w}])"),
    "bar behind braces": ("{", r"\{\{[^\W\d][\w ]*\|"),
    "brace": ("{}", r"[{}]"),
    "two apostrophes": ("'", r"(?<!')'{2,5}(?!')"),
    "three apostrophes": ("'", r"(?<!')'{3}(?!')"),
    "equals at both ends": ("=", r"^={2,6}[ \t]*[^=\n].*={2,6}[ \t]*$"),
    "run of equals": ("=", r"^[ \t]{0,3}={3,}[ \t]*$"),
    "run of dashes": ("-*_", r"^[ \t]{0,3}(?:-{3,}|(?:\*[ \t]*){3,}|_{3,})[ \t]*$"),
    "bar": ("|", r"\|"),
    "bars at both ends": ("|", r"^[ \t]*\|[^\n|]*\S.*\|[ \t]*$"),
    "bar at the start with a sign": ("|", r"^[ \t]*(?:\{\||\|\}|\|-)"),
    "dashes between bars": ("|", r"^[ \t|]*:?-{2,}:?[ \t]*\||\|[ \t]*:?-{2,}:?[ \t|]*$"),
    "angle at the start": (">", r"^ {0,3}>[ \t]?(?=\S)"),
    "address in angles": ("<", r"<(?:https?|ftp|mailto):[^\s<>]+>"),
    "word between underscores": ("_#", r"__(?:NO)?[A-Z]{3,}__|#(?:REDIRECT|WEITERLEITUNG)\b"),
    "backslash before letters": ("\\", r"\\[A-Za-z]{2,}"),
    "letters, backslash and brace": ("\\", r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{"),
    "path": ("\\", r"\b[A-Za-z]:\\|\\\w+\\|\\\w+\.\w"),
    "backslash and bracket": ("\\", r"(?<!\\)\\[\[\]()](?![\w\\])|\\\(.+?\\\)|\\\[.+?\\\]"),
    "dollars around signs": ("$", r"(?<![\\$\w])\$(?=[^\s$\d]|\d[^$\n ]*[\\^_=+])(?=[^$\n]*[\\^_={}+<>*/|-]|\s*[A-Za-z](?:\([^()$]*\))?\s*\$)[^$\n]*?[^\s$\\]\$(?![\d$])"),
    "dollar": ("$", r"\$"),
    "two dollars": ("$", r"\$\$"),
    "dollar before a figure": ("$", r"\$ ?\d"),
    "caret or underscore and brace": ("^_", r"[\^_]\{"),
    "list mark": ("-*+.)", r"^[ \t]*(?:[-*+]|\d{1,3}[.)])[ \t]+\S"),
    "code sign": ("{};=(", r"[{};]\s*$|\w\([^\n]*\):?\s*$|(?<![=<>!])=(?!=)"),
    "code word": ("abcdefghijklmnopqrstuvwxyzS", r"^\s*(?:def|class|for|while|return|import|from|function|const|let|SELECT|INSERT|UPDATE)\b"),
}
UNSEEN = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff]")
COMPILED = [(frozenset(signs), re.compile(pattern, re.I if "element name" in name else 0)) for name, (signs, pattern) in SHAPES.items()]
BASE = ("words", "link density", "words before", "link density before", "words after", "link density after", "end mark", "in code", "in a table")
FEATURES = (*BASE, *SHAPES)


def features(blocks: list[tuple[str, str]]) -> np.ndarray:
    x = np.zeros((len(blocks), len(FEATURES)), np.float32)
    for i, (s, inside) in enumerate(blocks):
        s = UNSEEN.sub("", s)
        n = _size(TAG.sub(" ", s) if "<" in s else s)
        linked = sum(_size(next((g for g in m.groups() if g), m[0])) for m in LINKS.finditer(s)) if "[" in s or "<a" in s.lower() or "://" in s else 0
        x[i, 0], x[i, 1] = n, min(1.0, linked / max(n, 1))
        x[i, 6] = s.rstrip()[-1:] in ".!?。！？…:;\"”»)"
        x[i, 7] = inside == "code"
        x[i, 8] = inside == "wikitable"
        if inside != "code":
            held = set(s)
            for j, (signs, pattern) in enumerate(COMPILED, len(BASE)):
                if not signs.isdisjoint(held):
                    x[i, j] = sum(1 for _ in pattern.finditer(s))
    if len(blocks) > 1:
        x[1:, 2:4] = x[:-1, 0:2]
        x[:-1, 4:6] = x[1:, 0:2]
    return x


@lru_cache(1)
def trees() -> tuple[list, list]:
    """(one tree for each markup, the tree for the role), trained on the labelled table."""
    xs, kinds, roles = [], [], []
    for text, labels in markup_table.PAGES:
        blocks = flat_blocks(text)
        assert len(blocks) == len(labels), (text, len(blocks), len(labels))
        xs.append(features(blocks))
        for label in labels:
            role, *held = label.split()
            roles.append(markup_table.ROLES.index(role))
            kinds.append([k in held for k in KINDS])
    x, k = np.concatenate(xs), np.array(kinds, int)
    return [tree.fit(x, k[:, i], 2, DEPTH) for i in range(4)], tree.fit(x, np.array(roles), len(markup_table.ROLES), DEPTH)


def judge(texts: list[str | None]) -> list[tuple[set[str], list[str], list[tuple[str, str]]]]:
    """For each text the markups held, and for its flat blocks the roles and the blocks; one tree pass for all."""
    all_blocks = [flat_blocks(t) if t and needs_look(t) else [] for t in texts]
    parts = [features(b) for b in all_blocks if b]
    if not parts:
        return [(set(), [], []) for _ in texts]
    x = np.concatenate(parts)
    by_kind, by_role = trees()
    held = np.stack([tree.predict(t, x) == 1 for t in by_kind], 1)
    role = tree.predict(by_role, x)
    out, at = [], 0
    for b in all_blocks:
        n = len(b)
        h = held[at : at + n].any(0) if n else ()
        out.append(({k for k, v in zip(KINDS, h) if v}, [markup_table.ROLES[r] for r in role[at : at + n]], b))
        at += n
    return out


def _hold(kept: list[str], s: str) -> str:
    kept.append(s)
    return f"\ue000{len(kept) - 1}\ue001"


HELD = re.compile("\ue000(\\d+)\ue001")


def _release(kept: list[str], t: str) -> str:
    while HELD.search(t):
        t = HELD.sub(lambda m: kept[int(m[1])] if int(m[1]) < len(kept) else "", t)
    return t


def _named(t: str) -> set[str]:
    """Names of the reference links that the text defines."""
    return {m[1].casefold() for m in MD_DEF.finditer(t)}


def is_formula(m: re.Match) -> bool:
    return m[4] is None or bool(re.search(r"[\\^_={}+<>*/|-]|^\s*[A-Za-z](?:\([^()]*\))?\s*$", m[4]))


def plain_entity(m: re.Match) -> str:
    return html.unescape(m[0]) if m[1] is None or m[1] + ";" in html.entities.html5 else m[0]


# Name spaces of wiki pages that are no words of the text.
WIKI_ASIDE = re.compile(r"\[\[(?:Category|Kategorie|Catégorie|Categoría|File|Image|Datei|Fichier|Archivo|分类|文件|カテゴリ|ファイル):[^\[\]\n]*\]\]", re.I)
TEX_ASIDE = re.compile(r"\\(?:bibliography\w*|includegraphics|usepackage|documentclass|vspace|hspace)\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}")
TEX_NAMED = re.compile(r"\\(?:label|cite\w*|ref|eqref|pageref)\*?(?:\[[^\]\n]*\])?\{([^{}\n]*)\}")
TEX_FILLED = re.compile(r"(?<![A-Za-z]:)\\[A-Za-z]{2,}\*?(?:\[[^\]\n]*\])?\{([^{}\n]*)\}")
TEX_WORD = re.compile(r"(?<![\w:\\/.])\\[A-Za-z]{2,}\*?(?![\w\\:/.])[ \t]?|\\[\[\]()](?!\w)")


def inline(t: str, kept: list[str], names: set[str]) -> str:
    """One block without the signs of inline markup; code and formulas keep their delimiters, entities are read last."""
    if "`" in t:
        t = TICKS.sub(lambda m: _hold(kept, m[0]), t)
    if "<" in t:
        t = re.sub(r"<(?:code|kbd|tt|samp)\b[^<>]*>([^<>`]+)</(?:code|kbd|tt|samp)\s*>", lambda m: _hold(kept, f"`{html.unescape(m[1])}`"), t, flags=re.I)
    if "\\" in t or "$" in t:
        t = TEX_MATH.sub(lambda m: _hold(kept, m[0]) if is_formula(m) else m[0], t)
    if "<" in t:
        t = AUTOLINK.sub(r"\1", t)
        t = re.sub(r"<img\b[^<>]*?\balt\s*=\s*[\"']([^\"'<>]*)[\"'][^<>]*>", r"\1", t, flags=re.I)
        t = re.sub(r"</t[dh]\s*>\s*<t[dh]\b[^<>]*>", " | ", t, flags=re.I)
        t = TAG.sub(lambda m: "\n" if m[2].lower() in BLOCK_TAGS and m[2].lower() not in ("td", "th") else "", t)
    if "<" in t or "-->" in t:
        t = CUT_TAG.sub("", t)
    if "\\" in t:
        t = TEX_NAMED.sub(r"[\1]", TEX_ASIDE.sub("", t))
        t = TEX_ENV.sub("", t)
        while (new := TEX_FILLED.sub(r"\1", t)) != t:
            t = new
        t = TEX_WORD.sub("", t)
    if "{{" in t:
        t = WIKI_TEMPLATE.sub("", t)
    if "[" in t:
        t = WIKI_LINK.sub(lambda m: m[2] or m[1], WIKI_ASIDE.sub("", t))
        t = WIKI_URL.sub(lambda m: m[1] or "", t)
        t = MD_LINK.sub(r"\2", t)
        t = MD_REF.sub(lambda m: m[2] if (m[3] or m[2]).casefold() in names else m[0], t)
    if "''" in t:
        t = WIKI_QUOTES.sub(lambda m: m[2] or "", t)
    if "*" in t or "__" in t or "~~" in t:
        for _ in range(2):
            t = MD_BOLD.sub(r"\2", t)
        t = MD_UNDER.sub(lambda m: m[0] if re.fullmatch(r"[a-z0-9_]+", m[1]) else m[1], t)
        t = MD_STRIKE.sub(r"\1", t)
    while "&" in t and (new := ENTITY.sub(plain_entity, t)) != t:
        t = new
    return t.replace("\xa0", " ").strip()


# A block of its own begins before an opening and after a closing tag of these.
SPLIT_TAG = "|".join(sorted({*BLOCK_TAGS} - {"td", "th", "br", "body", "head", "html"}, key=len, reverse=True))
BEFORE_TAG, AFTER_TAG = re.compile(rf"(?<=\S)[ \t]*(?=<(?:{SPLIT_TAG})(?=[\s/>]))", re.I), re.compile(rf"(</(?:{SPLIT_TAG})\s*>)[ \t]*(?=\S)", re.I)
LEVEL = re.compile(r"^\s*(?:(#{1,6})\s+(.*?)\s*#*\s*$|(={2,6})\s*([^=].*?)\s*=+\s*$|<h([1-6])\b[^<>]*>(.*)$|\\(sub)?(sub)?(?:section|chapter|title)\*?\{([^{}\n]*)\}(.*)$)", re.I | re.S)
MARK = re.compile(r"^([ \t]*)(?:([-*+])|(\d{1,3})[.)]|(<li\b[^<>]*>)|(\\item)\b)[ \t]*(\[[ xX]\][ \t])?", re.I)
ENUMERATION = re.compile(r"<(/?)(ol|ul)\b|\\(begin|end)\{(enumerate|itemize)\}", re.I)


def clean(text: str) -> str:
    """The text without its markup, written block by block from the roles that the tree gives.

    One notation is used for structure: headings begin with as many # as their level (a title set apart by nothing but
    its place stays as it is), items of lists with "- " or their number, rows of tables have their cells between bars,
    code stands verbatim in fences or ticks, formulas keep their delimiters.  All other signs go, their words stay.
    """
    if not needs_look(text):
        return text
    kept: list[str] = []
    t = text.replace("\ue000", "").replace("\ue001", "")
    names = _named(t)
    parts, at = [], 0
    for start, a, b, end in fences(t) if "```" in t or "~~~" in t else ():
        opening = t[start:a].strip().lstrip("`~").strip()
        parts += [t[at:start], _hold(kept, f"```{opening}\n" + t[a:b].rstrip("\n") + "\n```") + ("\n" if t[end - 1 : end] == "\n" else "") if b > a else ""]
        at = end
    t = "".join([*parts, t[at:]])
    if "<" in t:
        t = COMMENT.sub("", SCRIPT.sub("", t))
        t = PRE.sub(lambda m: "\n" + _hold(kept, "```\n" + html.unescape(TAG.sub("", m[1])).strip("\n") + "\n```") + "\n", t)
        t = AFTER_TAG.sub(r"\1\n", BEFORE_TAG.sub("\n", t))
    lines = t.split("\n")
    blocks, depth = [], False
    for x in lines:
        depth = depth or x.lstrip().startswith("{|")
        blocks.append((x, "wikitable" if depth else ""))
        depth = depth and not x.lstrip().startswith("|}")
    live = [i for i, x in enumerate(lines) if x.strip()]
    roles = dict(zip(live, (markup_table.ROLES[r] for r in tree.predict(trees()[1], features([blocks[i] for i in live]))))) if live else {}
    out: list[str] = []
    ordered: list[int] = []  # numbers reached in the lists that are open; -1 for lists without numbers
    for i, x in enumerate(lines):
        role = roles.get(i, "")
        for m in ENUMERATION.finditer(x):
            opening = not m[1] and m[3] != "end"
            if opening:
                ordered.append(0 if (m[2] or m[4]).lower() in ("ol", "enumerate") else -1)
            elif ordered:
                ordered.pop()
        if not role:
            out.append("")
        elif HELD.fullmatch(x.strip()):
            out.append(x.strip())
        elif MD_SPLIT.search(x) or MD_DEF.search(x) or FENCE_LINE.search(x):
            continue
        elif MD_RULE.search(x):
            if out and out[-1] and x.strip()[0] in "=-" and not out[-1].startswith(("#", "- ", "|", "\ue000")):
                out[-1] = ("# " if x.strip()[0] == "=" else "## ") + out[-1]
        elif blocks[i][1]:
            cells = [inline(c, kept, names) for c in re.split(r"\|\||!!", re.sub(r"^\s*[|!][-+}]?", "", x))] if not re.match(r"\s*(?:\{\||\|-|\|\})", x) else []
            if any(cells):
                out.append("| " + " | ".join(cells) + " |")
        elif role == "code" and not TAG.search(x) and (x.lstrip().startswith("#") or not LEVEL.match(x)):
            out.append(x.rstrip())
        elif m := LEVEL.match(x):
            words = inline(m[2] or m[4] or m[6] or m[9] or "", kept, names)
            level = len(m[1] or "") or len(m[3] or "") or int(m[5] or 0) or 1 + bool(m[7]) + bool(m[8])
            if words:
                out.append("#" * level + " " + words)
            if m[10] and (rest := inline(m[10], kept, names)):
                out.append(rest)
        elif m := MARK.match(x):
            words = inline(x[m.end() :], kept, names)
            mark = "- "
            if m[3]:
                mark = m[3] + ". "
            elif (m[4] or m[5]) and ordered and ordered[-1] >= 0:
                ordered[-1] += 1
                mark = f"{ordered[-1]}. "
            if words:
                out.append(m[1] + mark + (m[6] or "") + words)
        elif role == "formula" and not TAG.search(x) and not inline(TEX_MATH.sub("", x), [], names).strip(" .,;"):
            out.append(x.rstrip())
        elif role == "table" and ("|" in x or re.search(r"<t[rdh]\b", x, re.I)):
            cells = inline(x.strip().strip("|"), kept, names).split("|")
            if any(c.strip() for c in cells):
                out.append("| " + " | ".join(c.strip() for c in cells) + " |")
        else:
            words = inline(MD_QUOTE.sub("", x), kept, names)
            if words or role not in ("rule", "stock", "table", "list") and not TAG.search(x):
                out.append(words)
    t = re.sub(r"\n{3,}", "\n\n", "\n".join(x.rstrip() for x in out)).strip("\n")
    return _release(kept, t)


def bare(text: str, drop_code: bool = False) -> str:
    """All words of a text without the signs of markup, for comparisons; with drop_code without code and formulas."""
    if not needs_look(text):
        return text
    kept: list[str] = []
    t = text.replace("\ue000", "").replace("\ue001", "")
    names = _named(t)
    if "```" in t or "~~~" in t:
        parts, at = [], 0
        for start, a, b, end in fences(t):
            parts += [t[at:start], "" if drop_code or end == a else _hold(kept, t[a:b].rstrip("\n")) + "\n"]
            at = end
        t = FENCE_LINE.sub("", "".join([*parts, t[at:]]))
    if "<" in t:
        t = COMMENT.sub("", SCRIPT.sub("", t))
        t = PRE.sub(lambda m: "\n" + ("" if drop_code else _hold(kept, html.unescape(TAG.sub("", m[1])))) + "\n", t)
        if drop_code:
            t = re.sub(r"<code\b[^<>]*>[^<>]*</code\s*>", " ", t, flags=re.I)
    if "`" in t:
        t = TICKS.sub(lambda m: "" if drop_code else _hold(kept, m[2]), t)
    if "\\" in t or "$" in t:
        t = TEX_MATH.sub(lambda m: m[0] if not is_formula(m) else "" if drop_code else _hold(kept, (m[1] or m[2] or m[3] or m[4]).strip()), t)
        t = re.sub(r"\\item\b[ \t]*", "- ", t)
    if "|" in t:
        t = re.sub(r"^[ \t]*(?:\{\||\|\}|\|-)[^\n]*$", "", MD_SPLIT.sub("", t), flags=re.M)
        t = re.sub(r"^[ \t]*\|(?!\|)|\|[ \t]*$", "", t, flags=re.M)
    t = MD_DEF.sub("", t) if names else t
    t = MD_QUOTE.sub("", MD_HEAD.sub(r"\2", WIKI_HEAD.sub(r"\2", MD_RULE.sub("", t))))
    t = inline(t, kept, names)
    t = re.sub(r"[ \t]+(?=\n|$)", "", re.sub(r"\n{3,}", "\n\n", t)).strip("\n")
    return _release(kept, t)
