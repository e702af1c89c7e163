"""Order of a page's tokens where tags are misnested: what a parser makes of them.

Tokens that cross are brought into an order in which every element ends inside its parent:
formatting elements are closed before a block that outlives them and opened again inside
it, or at the next text after a block that ended them; what may not stand in a table goes
before it; HTML elements leave svg and math.  The rules run on tag names only, one pass per
page, in the task that holds the page.  A page without crossings keeps its tokens as they are.
"""

import sys
from collections import Counter

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions import fixed
from ..functions.html import split_tokens, tag_of

# What an entry of the new order is: token * 3 + kind.
AS_IS, AGAIN, END = range(3)

_BY_LINE = "\n"

# --- Fixed values of the HTML standard: element classes of tree construction ---
FORMATTING = frozenset(["a", "b", "big", "code", "em", "font", "i", "nobr", "s", "small", "strike", "strong", "tt", "u"])
SPECIAL = frozenset([
    "address", "applet", "area", "article", "aside", "base", "basefont", "bgsound", "blockquote", "body", "br", "button",
    "caption", "center", "col", "colgroup", "dd", "details", "dir", "div", "dl", "dt", "embed", "fieldset", "figcaption",
    "figure", "footer", "form", "frame", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr",
    "html", "iframe", "img", "input", "keygen", "li", "link", "listing", "main", "marquee", "menu", "meta", "nav",
    "noembed", "noframes", "noscript", "object", "ol", "p", "param", "plaintext", "pre", "script", "search", "section",
    "select", "source", "style", "summary", "table", "tbody", "td", "template", "textarea", "tfoot", "th", "thead",
    "title", "tr", "track", "ul", "wbr", "xmp",
])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
MARKED = frozenset(["applet", "marquee", "object", "template", "td", "th", "caption"])
SCOPE = frozenset(["applet", "caption", "html", "table", "td", "th", "marquee", "object", "template"])
LISTS = frozenset(["ol", "ul"])
TABLE = frozenset(["table", "tbody", "thead", "tfoot", "tr"])
CELLS = frozenset(["td", "th", "caption"])
TABLE_PARTS = frozenset(["caption", "colgroup", "col", "tbody", "thead", "tfoot", "tr", "td", "th"])
END_LEFT_OUT = frozenset(["p", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "colgroup"])
PHRASING_VOID = frozenset(["area", "br", "embed", "img", "input", "keygen", "wbr"])
REOPENING = frozenset(["applet", "button", "marquee", "object", "select"])
INTEGRATION = frozenset(["foreignobject", "desc", "title", "mi", "mo", "mn", "ms", "mtext", "annotation-xml"])
BREAKOUT = frozenset([
    "b", "big", "blockquote", "body", "br", "center", "code", "dd", "div", "dl", "dt", "em", "embed", "h1", "h2", "h3",
    "h4", "h5", "h6", "head", "hr", "i", "img", "li", "listing", "menu", "meta", "nobr", "ol", "p", "pre", "ruby", "s",
    "small", "span", "strike", "strong", "sub", "sup", "table", "tt", "u", "ul", "var",
])
VOID = frozenset(fixed.VOID_TAGS)
RAW = frozenset(fixed.RAW_TEXT_TAGS)
PARAGRAPH_ENDERS = frozenset(fixed.PARAGRAPH_ENDERS)


class Element:
    """An open element: its start tag's token, and the list that its tags and content go to.

    pre and post lie just before and after a block's start tag, before holds what is moved
    out of a table; frame is the innermost part of a table around the content.
    """

    __slots__ = ("at", "before", "foreign", "frame", "key", "open", "out", "post", "pre", "tag")

    def __init__(self, tag, at, key, out, frame, foreign=False):
        self.tag, self.at, self.key, self.out, self.frame, self.foreign = tag, at, key, out, frame, foreign
        self.open, self.pre, self.post, self.before = True, None, None, None

    def copy(self, out, frame):
        return Element(self.tag, self.at, self.key, out, frame)


class Order:
    """One pass over a page's tags: the stack of open elements and the active formatting."""

    def __init__(self):
        self.out, self.stack, self.active = [], [], []
        self.n_open, self.changed, self.fostering = Counter(), False, False

    # --- places and the stack ---

    def frame(self):
        return self.stack[-1].frame if self.stack else None

    def foreign(self):
        return bool(self.stack) and self.stack[-1].foreign and self.stack[-1].tag not in INTEGRATION

    def here(self):
        """The list that the next piece goes to."""
        if not self.stack:
            return self.out
        if self.fostering and self.stack[-1].tag in TABLE:
            table = next((e for e in reversed(self.stack) if e.tag == "table"), None)
            if table is not None:
                self.changed = True
                return table.before
        return self.stack[-1].out

    def put(self, i):
        self.here().append(i * 3 + AS_IS)

    def push(self, tag, i, key=None, kind=AS_IS, foreign=False):
        out = self.here()
        framed = tag in TABLE or tag in CELLS or tag == "template"
        e = Element(tag, i, key, out, tag if framed and not foreign else self.frame(), foreign)
        blocks = tag in SPECIAL and not foreign
        if blocks:
            e.pre, e.post, e.before = [], [], []
            out += [e.pre, e.before]
        out.append(i * 3 + kind)
        if blocks:
            out.append(e.post)
        self.stack.append(e)
        self.n_open[tag] += 1
        if tag in MARKED and not foreign:
            self.active.append(None)
        return e

    def pop(self, k, own=None):
        """Ends all from place k of the stack on; token `own` is the end tag of that at k."""
        while len(self.stack) > k:
            e = self.stack.pop()
            e.open = False
            self.n_open[e.tag] -= 1
            if own is not None and len(self.stack) == k:
                e.out.append(own * 3 + AS_IS)
            else:
                e.out.append(e.at * 3 + END)
                self.changed |= e.tag not in END_LEFT_OUT
            if e.tag in MARKED and not e.foreign:
                while self.active and self.active.pop() is not None:
                    pass

    def place(self, tags, bounds=SCOPE):
        """Place in the stack of the innermost of the tags, if it is in scope."""
        if not any(self.n_open[t] > 0 for t in tags):
            return None
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].tag in tags:
                return k
            if self.stack[k].tag in bounds:
                return None
        return None

    def end(self, tags, i=None, bounds=SCOPE):
        k = self.place(tags, bounds)
        if k is not None:
            self.pop(k, i)
        return k is not None

    # --- formatting elements ---

    def reopen(self):
        k = len(self.active)
        while k and self.active[k - 1] is not None and not self.active[k - 1].open:
            k -= 1
        for n in range(k, len(self.active)):
            e = self.active[n]
            self.active[n] = self.push(e.tag, e.at, e.key, AGAIN)
            self.changed = True

    def last_active(self, tag):
        for e in reversed(self.active):
            if e is None:
                return None
            if e.tag == tag:
                return e
        return None

    def format(self, tag, i, key):
        if tag in ("a", "nobr"):
            former = self.last_active(tag)
            if former is not None and (tag == "a" or self.place((tag,)) is not None):
                self.adopt(tag, None)
                if former in self.active:
                    self.active.remove(former)
                if former.open:
                    self.pop(self.stack.index(former))
        self.reopen()
        equal = []
        for e in reversed(self.active):
            if e is None:
                break
            if e.key == key:
                equal.append(e)
        if len(equal) >= 3:  # the standard keeps three equal ones
            self.active.remove(equal[-1])
        self.active.append(self.push(tag, i, key))

    def adopt(self, tag, i):
        """The end tag i of a formatting element; None: implied by the next of its kind."""
        if self.stack and self.stack[-1].tag == tag and self.stack[-1] not in self.active:
            return self.pop(len(self.stack) - 1, i)
        for _ in range(8):  # as often as the standard does
            e = self.last_active(tag)
            if e is None:
                return self.other_end(tag, i)
            if not e.open:
                return self.active.remove(e)
            k = self.stack.index(e)
            if any(x.tag in SCOPE for x in self.stack[k + 1:]):
                return None
            b = next((n for n in range(k + 1, len(self.stack)) if self.stack[n].pre is not None), None)
            if b is None:
                self.pop(k, i)
                return self.active.remove(e)
            self.split(k, b)
        return None

    def split(self, k, b):
        """Ends the formatting element at k before the block at b, and opens it again inside."""
        e, between, block = self.stack[k], self.stack[k + 1:b], self.stack[b]
        self.changed = True
        for old in between[:-3]:
            if old in self.active:
                self.active.remove(old)
        block.pre += [old.at * 3 + END for old in reversed(between)] + [e.at * 3 + END]
        again = []
        for old in between:
            old.open = False
            if old in self.active:
                again.append(old.copy(block.out, e.frame))
                self.active[self.active.index(old)] = again[-1]
                block.pre.append(old.at * 3 + AGAIN)
            else:
                self.n_open[old.tag] -= 1
        e.open = False
        inside = e.copy(block.out, block.frame)
        block.post.insert(0, e.at * 3 + AGAIN)
        self.stack[k:b + 1] = [*again, block, inside]
        after = again[-1] if again else e
        self.active.insert(self.active.index(after) + 1, inside)
        self.active.remove(e)

    # --- tokens ---

    def other_end(self, tag, i):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].tag == tag:
                return self.pop(k, i)
            if self.stack[k].pre is not None:
                return None
        return None

    def text(self, i, blank):
        if self.stack and self.stack[-1].tag in TABLE and not blank:
            self.fostering = True
        if not self.foreign() and not (self.stack and self.stack[-1].tag in TABLE and blank):
            self.reopen()
        self.put(i)
        self.fostering = False

    def start(self, tag, i, key, closed):
        if tag in ("html", "head", "body"):
            return self.put(i)
        if self.foreign():
            if tag not in BREAKOUT:
                return self.put(i) if closed or tag in RAW else self.push(tag, i, foreign=True)
            while self.foreign():
                self.pop(len(self.stack) - 1)
        if tag in TABLE_PARTS and self.frame() is not None and self.frame() != "template":
            return self.table_part(tag, i)
        if self.frame() in TABLE:
            if tag in ("script", "style", "form", "#hidden"):
                return self.stack[-1].out.append(i * 3)
            if tag == "table":
                self.end(("table",), bounds=())
            else:
                self.fostering = True
        self.body_start(tag, i, key, closed)
        self.fostering = False
        return None

    def table_part(self, tag, i):
        if self.frame() in CELLS:
            self.end(CELLS, bounds=("table",))
        to = ("table",)
        if tag == "tr":
            to = ("table", "tbody", "thead", "tfoot")
        elif tag in ("td", "th", "col"):
            to = (*TABLE, "colgroup")
        k = max((n for n, e in enumerate(self.stack) if e.tag in to), default=len(self.stack) - 1)
        self.pop(k + 1)
        if tag == "col":
            self.put(i)
        else:
            self.push(tag, i)

    def body_start(self, tag, i, key, closed):
        if tag in ("li", "dd", "dt"):
            for k in range(len(self.stack) - 1, -1, -1):
                e = self.stack[k]
                if e.tag == tag or (tag != "li" and e.tag in ("dd", "dt")):
                    self.pop(k)
                    break
                if e.pre is not None and e.tag not in ("address", "div", "p"):
                    break
        if tag in PARAGRAPH_ENDERS:
            self.end(("p",), bounds=SCOPE | {"button"})
        if tag in HEADINGS and self.stack and self.stack[-1].tag in HEADINGS:
            self.pop(len(self.stack) - 1)
        if tag in ("option", "optgroup") and self.stack and self.stack[-1].tag == "option":
            self.pop(len(self.stack) - 1)
        if tag == "button":
            self.end(("button",))
        if tag in FORMATTING:
            return self.format(tag, i, key)
        if tag in REOPENING or tag in PHRASING_VOID or (tag not in SPECIAL and tag != "#hidden"):
            self.reopen()
        if tag in VOID or tag in RAW or tag == "#hidden" or (closed and tag in ("svg", "math")):
            return self.put(i)
        return self.push(tag, i, foreign=tag in ("svg", "math"))

    def close(self, tag, i):
        if tag in ("html", "head", "body"):
            return self.put(i)
        if tag == "table" or tag in TABLE_PARTS:
            return self.end((tag,), i, ("table", "template") if tag != "table" else ("template",))
        if self.frame() in TABLE and tag in ("p", "br"):
            self.fostering = True
        if tag == "p" or tag == "br":
            if tag == "br" or not self.end(("p",), i, SCOPE | {"button"}):
                self.put(i)
        elif tag in FORMATTING:
            self.adopt(tag, i)
        elif tag in HEADINGS:
            k = self.place(HEADINGS)
            if k is not None:
                self.pop(k, i if self.stack[k].tag == tag else None)
        elif tag in SPECIAL:
            self.end((tag,), i, SCOPE | LISTS if tag == "li" else SCOPE - {tag})
        else:
            self.other_end(tag, i)
        self.fostering = False
        return None


def new_order(names: list[str]) -> list[int] | None:
    """The order of a page's tokens, as token * 3 + kind; null if they stay as they are.

    A name is that of a tag, with a slash before it for an end tag, and = and what tells
    attributes apart after it, and a last slash for a tag that closes itself; text is #text
    or #space, all that is neither begins with #.
    """
    page = Order()
    for i, name in enumerate(names):
        if name in ("#text", "#space"):
            page.text(i, name == "#space")
        elif name[0] == "#" and name != "#hidden":
            (page.stack[-1].out if page.stack else page.out).append(i * 3)
        elif name[0] == "/":
            page.close(name[1:].partition("=")[0], i)
        else:
            tag = name.rstrip("/").partition("=")[0]
            page.start(tag, i, name, name[-1] == "/")
    if not page.changed:
        return None
    page.pop(0)
    flat, todo = [], [iter(page.out)]
    while todo:
        for piece in todo[-1]:
            if isinstance(piece, list):
                todo.append(iter(piece))
                break
            flat.append(piece)
        else:
            todo.pop()
    return flat


# Executors need not have this package: the functions above travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@F.pandas_udf(ArrayType(IntegerType()))
def _orders(names: pd.Series) -> pd.Series:
    return names.map(lambda page: None if page is None else new_order(page.split(_BY_LINE)))


_INLINE = "|".join(sorted(FORMATTING | HEADINGS | {"span", "label", "cite", "q", "abbr", "sub", "sup", "mark", "time", "button"}))
_PARTS = "|".join(sorted(TABLE_PARTS | {"table", "script", "style", "template"}))
_OUT = "|".join(sorted(BREAKOUT))
# An inline element, heading or button that holds only text and void elements.
_PLAIN = rf"(?i)<({_INLINE})(?:\s[^>]*+)?>(?:[^<]++|<(?:img|br|wbr|input)\b[^>]*+>)*+</\1\s*+>"
# What is left then may be misnested; so may text or elements straight in a table, and HTML in svg or math.
_MISNESTED = rf"(?i)</?(?:{_INLINE})[\s/>]"
_IN_TABLE = (
    r"(?i)(?:<(?:table|tbody|thead|tfoot|tr)\b[^>]*+>|</(?:td|th|tr|tbody|thead|tfoot|caption|colgroup)\s*+>)"
    rf"\s*+(?!\z|<!--|</?(?:{_PARTS})\b)"
)
_IN_FOREIGN = rf"(?i)<(?:svg|math)\b[^>]*+>(?:[^<]++|<(?!/(?:svg|math)\b|(?:{_OUT})\b))*+<(?:{_OUT})\b"


def _is_suspect(html: Column) -> Column:
    """Can a page's tags be misnested?  Elements that hold only text are taken out, from the inside."""
    rest = html
    for _ in range(3):
        rest = F.regexp_replace(rest, _PLAIN, "")
    return rest.rlike(_MISNESTED) | html.rlike(_IN_TABLE) | html.rlike(_IN_FOREIGN)


def _names_of(tokens: Column) -> Column:
    """Names of tokens as new_order reads them; the plain tag, the commonest, is found first."""

    def named(pair):
        tok, head = pair["tok"], pair["head"]
        name = F.regexp_replace(head, "^<", "")
        unfinished = ~tok.endswith(">") & ~name.isin(*fixed.RAW_TEXT_TAGS)
        hidden = (head == "<input") & tok.rlike("""(?i)\\stype\\s*=\\s*["']?hidden\\b""")
        with_attributes = F.concat(
            name, F.lit("="), F.crc32(tok.cast("binary")), F.when(tok.endswith("/>"), "/").otherwise(""))
        return (
            F.when((head == "") & tok.startswith("<"), "#")
            .when(head == "", F.when(tok.rlike(r"[^ \t\n\f\r]"), "#text").otherwise("#space"))
            .when((F.length(tok) == F.length(head) + 1) & tok.endswith(">"), name)
            .when(unfinished, "#").when(hidden, "#hidden").otherwise(with_attributes)
        )

    def headed(tok):
        head = F.lower(F.regexp_extract(tok, r"^</?[a-zA-Z][^\s/>]*+", 0))
        return F.struct(tok.alias("tok"), head.alias("head"))

    return F.transform(F.transform(tokens, headed), named)


def token_order(html: Column) -> Column:
    """New order of a page's tokens, null where they stay; null html gives null.

    Only pages that a few patterns cannot clear are split into names for the pass in Python.
    """
    names = F.array_join(_names_of(split_tokens(html)), _BY_LINE)
    return _orders(F.when(_is_suspect(html), names))


def in_order(tokens: Column, order: Column) -> Column:
    """A page's tokens in their new order.

    End tags of elements that end early and copies of start tags that open them again are
    added, end tags that end nothing are left out.
    """
    def token(entry):
        tok, kind = F.get(tokens, F.floor(entry / 3).cast("int")), entry % 3
        return F.when(kind == END, F.concat(F.lit("</"), tag_of(tok), F.lit(">"))).otherwise(tok)

    return F.when(order.isNull(), tokens).otherwise(F.transform(order, token))
