"""The tree of an HTML document, built by the standard's insertion modes with scripting off.

No HTML library is at hand, so this is the part of the standard that decides where elements and texts end up: the implied html, head
and body, implied end tags, scopes, tables with foster parenting, formatting elements that are opened again and adopted, selects,
templates and foreign elements. Any string gives a tree, in time that is linear in its length:

- Positions of the open elements are kept by name, so that neither a scope nor a stray end tag is looked for through the stack.
- Elements below DEEPEST open ones are closed at once; at most FORMATS formatting elements are held, and elements that are opened
  again never outnumber those of the source by more than AGAIN times. Documents beyond these bounds differ from a browser's tree.
- Comments, processing instructions, unknown declarations and marked sections only part texts."""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict

DEEPEST, FORMATS, AGAIN = 512, 64, 2
#: So near to the top of the stack an element's scope is read off the stack, which is shorter than the list of bounds.
NEAR = 8
SPACE = " \t\n\f\r"


def names(text: str) -> frozenset[str]:
    return frozenset(text.split())


# Element names by the roles that the HTML standard gives them.
VOID = names("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr")
IN_HEAD = names("base basefont bgsound link meta noframes noscript script style template title")
RAW = names("iframe noembed noframes script style xmp")
ESCAPABLE_RAW = names("textarea title")
IMPLIED = names("dd dt li optgroup option p rb rp rt rtc")
HEADINGS = names("h1 h2 h3 h4 h5 h6")
BLOCKS = names(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup listing main menu nav ol p pre search section summary ul"
)
FORMATTING = names("a b big code em font i nobr s small strike strong tt u")
SPECIAL = (
    VOID - names("embed keygen") | IN_HEAD | RAW | HEADINGS | BLOCKS
    | names("applet body button caption colgroup dd dt form frameset head html li marquee object plaintext select table tbody td textarea tfoot th thead tr")
) - names("dialog")
GROUPS, CELLS, STRUCTURE = names("tbody tfoot thead"), names("td th"), names("caption col colgroup tbody td tfoot th thead tr")
TABLE_PARTS = GROUPS | names("table tr")
SCOPE = names("applet caption foreignobject html marquee object table td template th")
BUTTON_SCOPE, LIST_SCOPE, TABLE_SCOPE = SCOPE | {"button"}, SCOPE | names("ol ul"), names("html table template")
CONTEXT = TABLE_PARTS | CELLS | names("caption colgroup select template svg math foreignobject frameset")
BREAKS_OUT = names(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strike strong sub sup table tt u ul var"
)

MARKUP = re.compile(r"<(?:(/?)([A-Za-z][^\t\n\f\r />]*)|(!--)|(!\[CDATA\[)|[!?]|/(?=[^A-Za-z]))")
COMMENT_END = re.compile(r"--!?>")
SKIPPED = re.compile(r"[\t\n\f\r /]*")
ATTRIBUTE = re.compile(r"""([^\t\n\f\r />][^\t\n\f\r />=]*)(?:[\t\n\f\r ]*=[\t\n\f\r ]*(?:"([^"]*)"|'([^']*)'|((?:[^\t\n\f\r >"'][^\t\n\f\r >]*)|(?=>))))?""")
CUT_VALUE = re.compile(r"[\t\n\f\r ]*=")
RAW_END = {x: re.compile(rf"</{x}(?=[\t\n\f\r />])", re.I) for x in RAW | ESCAPABLE_RAW}
NAMED = re.compile(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*)(;?)(=?)")


class Node:
    """An element. kids: elements, texts as lists of pieces, and None for a comment. source: a title's text as it is written."""

    __slots__ = ("attrs", "kids", "open", "source", "tag", "up")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids, self.open, self.up, self.source = tag, attrs, [], False, None, ""


def attribute_text(value: str) -> str:
    """Character references of an attribute; a name without a semicolon in front of = or a letter is none."""
    if "&" not in value:
        return value

    def one(m: re.Match) -> str:
        if m[1][0] != "#" and not m[2] and (m[3] or m[1] not in entities.entities.html5):
            return m[0]
        return entities.unescape(f"&{m[1]};") + m[3]

    return NAMED.sub(one, value)


def attributes(html: str, at: int) -> tuple[dict[str, str], bool, int]:
    """(attributes, whether the tag closes itself, where it ends) from behind a tag's name; the end is -1 if there is none."""
    found: dict[str, str] = {}
    if html.startswith(">", at):
        return found, False, at + 1
    while True:
        skipped = SKIPPED.match(html, at)
        at = skipped.end()
        if at >= len(html):
            return found, False, -1
        if html[at] == ">":
            return found, skipped[0].endswith("/"), at + 1
        m = ATTRIBUTE.match(html, at)
        at = m.end()
        value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4]
        if value is None and CUT_VALUE.match(html, at):
            return found, False, -1  # a quote that never ends
        found.setdefault(m[1].lower(), attribute_text(value or ""))


def last_index(items: list, wanted) -> int:
    """Where an item lies, looked for from the end."""
    for i in range(len(items) - 1, -1, -1):
        if items[i] is wanted:
            return i
    return -1


class Tree:
    """The document: root is the html element; head and body may be None, and body may be a frameset."""

    def __init__(self, html: str):
        self.root = Node("html", {})
        self.head: Node | None = None
        self.body: Node | None = None
        self.stack: list[Node] = []
        self.at: dict[str, list[int]] = defaultdict(list)
        self.contexts: list[str] = []
        self.formats: list[Node | None] = []
        self.form: Node | None = None
        self.foster = False
        self.elements, self.reopened = 1, 0
        self.push(self.root)
        self.read(html.replace("\r\n", "\n").replace("\r", "\n") if "\r" in html else html)

    # Tokens

    def read(self, html: str) -> None:
        at, size = 0, len(html)
        while at < size:
            m = MARKUP.search(html, at)
            stop = m.start() if m else size
            if stop > at:
                self.text(entities.unescape(html[at:stop]))
            if not m:
                return
            at = m.end()
            if m[2]:
                tag = m[2].lower()
                attrs, closed, at = attributes(html, at)
                if at < 0:
                    return
                if m[1]:
                    self.end(tag)
                    continue
                self.raw: Node | None = None
                self.start(tag, attrs, closed)
                if self.raw is not None:
                    at = self.raw_text(html, at, self.raw)
                elif tag in ("pre", "listing") and html.startswith("\n", at):
                    at += 1
                if tag == "plaintext" and self.stack[-1].tag == tag:
                    self.text(html[at:])
                    return
            else:
                at = self.other(html, m)

    def other(self, html: str, m: re.Match) -> int:
        """Comments and what is read as one; the end."""
        foreign = self.contexts and self.contexts[-1] in ("svg", "math")
        if m[4] and foreign:
            stop = html.find("]]>", m.end())
            self.text(html[m.end() : stop if stop >= 0 else len(html)])
            return stop + 3 if stop >= 0 else len(html)
        kids = self.stack[-1].kids
        if not html.startswith("<!doctype", m.start()) and not html.startswith("</>", m.start()) and kids and isinstance(kids[-1], list):
            kids.append(None)
        if m[3]:
            if html.startswith(">", m.end()) or html.startswith("->", m.end()):
                return html.index(">", m.end()) + 1
            close = COMMENT_END.search(html, m.end())
            return close.end() if close else len(html)
        stop = html.find(">", m.start())
        return stop + 1 if stop >= 0 else len(html)

    def raw_text(self, html: str, at: int, node: Node) -> int:
        """Texts that hold no markup go to their element, up to its end tag."""
        m = RAW_END[node.tag].search(html, at)
        stop = m.start() if m else len(html)
        text = html[at:stop]
        if node.tag in ESCAPABLE_RAW:
            node.source = text
            text = entities.unescape(text.removeprefix("\n") if node.tag == "textarea" else text)
        if text:
            node.kids.append([text])
        if not m:
            return len(html)
        close = attributes(html, m.end())[2]
        return close if close >= 0 else len(html)

    # The stack of open elements

    def push(self, node: Node) -> bool:
        if len(self.stack) >= DEEPEST:
            return False
        node.open = True
        self.at[node.tag].append(len(self.stack))
        self.stack.append(node)
        if node.tag in CONTEXT:
            self.contexts.append(node.tag)
        return True

    def pop(self) -> Node:
        node = self.stack.pop()
        node.open = False
        self.at[node.tag].pop()
        if node.tag in CONTEXT:
            self.contexts.pop()
        return node

    def restack(self, stack: list[Node]) -> None:
        """Another order of open elements: only adoption and the ends of forms and heads need it."""
        for x in self.stack:
            x.open = False
        self.stack, self.contexts = [], []
        self.at.clear()
        for x in stack:
            self.push(x)

    def pop_to(self, *tags: str) -> None:
        while len(self.stack) > 1 and self.pop().tag not in tags:
            pass

    def imply(self, but: str = "") -> None:
        while self.stack[-1].tag in IMPLIED and self.stack[-1].tag != but:
            self.pop()

    def in_scope(self, tag: str, bounds: frozenset[str] = SCOPE) -> bool:
        own = self.at.get(tag)
        if own and len(self.stack) - own[-1] <= NEAR:
            return not any(x.tag in bounds for x in self.stack[own[-1] + 1 :])
        return bool(own) and all(not (x := self.at.get(b)) or x[-1] <= own[-1] for b in bounds)

    def close_p(self) -> None:
        if self.in_scope("p", BUTTON_SCOPE):
            self.imply("p")
            self.pop_to("p")

    # Insertion

    def place(self) -> tuple[Node, int]:
        """(parent, index among its children) of what comes next; what has no place in a table goes in front of it."""
        to = self.stack[-1]
        if self.foster and to.tag in TABLE_PARTS and self.at["table"]:
            table = self.stack[self.at["table"][-1]]
            if table.up is not None and (i := last_index(table.up.kids, table)) >= 0:
                return table.up, i
        return to, len(to.kids)

    def insert(self, tag: str, attrs: dict[str, str], keep: bool = True) -> Node:
        node = Node(tag, attrs)
        node.up, i = self.place()
        node.up.kids.insert(i, node)
        self.elements += 1
        if keep:
            self.push(node)
        return node

    def insert_raw(self, tag: str, attrs: dict[str, str]) -> None:
        self.raw = self.insert(tag, attrs, keep=False)

    def insert_text(self, text: str) -> None:
        parent, i = self.place()
        if i and isinstance(parent.kids[i - 1], list):
            parent.kids[i - 1].append(text)
        else:
            parent.kids.insert(i, [text])

    def mark(self) -> None:
        self.formats.append(None)

    def unmark(self) -> None:
        while self.formats and self.formats.pop() is not None:
            pass

    def reopen(self) -> None:
        """Formatting elements that were closed by an ancestor's end are opened again."""
        held = self.formats
        if not held or held[-1] is None or held[-1].open:
            return
        i = len(held) - 1
        while i and held[i - 1] is not None and not held[i - 1].open:
            i -= 1
        for k in range(i, len(held)):
            if self.reopened > AGAIN * self.elements + FORMATS or len(self.stack) >= DEEPEST:
                return
            self.reopened += 1
            held[k] = self.insert(held[k].tag, held[k].attrs)

    def format(self, tag: str, attrs: dict[str, str]) -> None:
        self.reopen()
        node = self.insert(tag, attrs)
        same = [x for x in self.formats[last_index(self.formats, None) + 1 :] if x.tag == tag and x.attrs == attrs]
        if len(same) >= 3:
            del self.formats[last_index(self.formats, same[0])]
        elif len(self.formats) >= FORMATS:
            del self.formats[0]
        self.formats.append(node)

    def adopt(self, tag: str) -> bool:
        """The end of a formatting element, whose elements may be cut by blocks. False: none is open."""
        if self.stack[-1].tag == tag and self.formats and self.formats[-1] is self.stack[-1]:
            self.formats.pop()
            self.pop()
            return True
        if self.stack[-1].tag == tag and last_index(self.formats, self.stack[-1]) < 0:
            self.pop()
            return True
        for turn in range(8):
            mine = next((x for x in reversed(self.formats[last_index(self.formats, None) + 1 :]) if x.tag == tag), None)
            if mine is None:
                return turn > 0
            if not mine.open:
                del self.formats[last_index(self.formats, mine)]
                return True
            if not self.in_scope(tag):
                return True
            low = last_index(self.stack, mine)
            block = next((k for k in range(low + 1, len(self.stack)) if self.stack[k].tag in SPECIAL), None)
            if block is None:
                while self.pop() is not mine:
                    pass
                del self.formats[last_index(self.formats, mine)]
                return True
            self.adopt_block(mine, low, block)
        return True

    def adopt_block(self, mine: Node, low: int, block: int) -> None:
        """The block goes to the formatting element's parent, copies of those between take what they held, the block's content gets one."""
        stack, furthest = list(self.stack), self.stack[block]
        spot, last, between = last_index(self.formats, mine), furthest, stack[low + 1 : block]
        copies: list[Node] = []
        for count, node in enumerate(reversed(between), 1):
            i = last_index(self.formats, node)
            if i >= 0 and count > 3:
                del self.formats[i]
                spot -= i < spot
                i = -1
            if i < 0:
                continue
            copy = Node(node.tag, node.attrs)
            self.formats[i] = copy
            if last is furthest:
                spot = i + 1
            self.move(last, copy)
            copies.append(copy)
            last = copy
        parent = stack[low - 1]
        if parent.tag in TABLE_PARTS and self.at["table"] and (table := stack[self.at["table"][-1]]).up is not None:
            self.move(last, table.up, last_index(table.up.kids, table))
        else:
            self.move(last, parent)
        copy = Node(mine.tag, mine.attrs)
        copy.kids, furthest.kids, copy.up = furthest.kids, [copy], furthest
        for x in copy.kids:
            if isinstance(x, Node):
                x.up = copy
        i = last_index(self.formats, mine)
        self.formats.insert(spot, copy)
        del self.formats[i + (spot <= i)]
        self.restack([*stack[:low], *reversed(copies), furthest, copy, *stack[block + 1 :]][:DEEPEST])

    def move(self, node: Node, to: Node, index: int = -1) -> None:
        if node.up is not None and (i := last_index(node.up.kids, node)) >= 0:
            del node.up.kids[i]
            if to is node.up and index > i:
                index -= 1
        node.up = to
        to.kids.insert(index if index >= 0 else len(to.kids), node)

    # Start tags

    def start(self, tag: str, attrs: dict[str, str], closed: bool = False) -> None:
        if tag == "html":
            for k, v in attrs.items():
                self.root.attrs.setdefault(k, v)
            return
        if self.body is None and not self.at["template"] and not self.before_body(tag, attrs):
            return
        context = self.contexts[-1] if self.contexts else ""
        if context in ("svg", "math") and self.start_foreign(tag, attrs, closed):
            return
        if context == "select":
            self.start_in_select(tag, attrs, closed)
        elif context == "frameset":
            if tag == "noframes":
                self.insert_raw(tag, attrs)
            elif tag in ("frameset", "frame"):
                self.insert(tag, attrs, tag == "frameset")
        elif context not in ("", "template", "foreignobject") and self.start_in_table(context, tag, attrs, closed):
            return
        else:
            self.foster = context in TABLE_PARTS
            self.start_in_body(tag, attrs, closed)
            self.foster = False

    def before_body(self, tag: str, attrs: dict[str, str]) -> bool:
        """Whether a tag (or text, named #) goes on to the body, which is then there."""
        if self.head is None:
            self.head = self.insert("head", attrs if tag == "head" else {})
        if tag == "head":
            return False
        if self.stack[-1].tag == "noscript" and tag not in ("basefont", "bgsound", "link", "meta", "noframes", "style"):
            self.pop()
        if tag in IN_HEAD and (self.head.open or tag != "noscript"):
            within = self.head.open
            if not within:
                self.push(self.head)
            self.start_in_head(tag, attrs)
            if not within:
                self.restack([x for x in self.stack if x is not self.head])
            return False
        while self.head.open:
            self.pop()
        self.body = self.insert("frameset" if tag == "frameset" else "body", attrs if tag in ("body", "frameset") else {})
        return tag not in ("body", "frameset")

    def start_in_head(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in VOID:
            self.insert(tag, attrs, keep=False)
        elif tag in ("template", "noscript"):
            self.insert(tag, attrs)
            if tag == "template":
                self.mark()
        else:
            self.insert_raw(tag, attrs)

    def start_foreign(self, tag: str, attrs: dict[str, str], closed: bool) -> bool:
        if tag in BREAKS_OUT or tag == "font" and attrs.keys() & {"color", "face", "size"}:
            while self.contexts and self.contexts[-1] in ("svg", "math"):
                self.pop()
            return False
        self.insert(tag, attrs, keep=not closed)
        return True

    def start_in_select(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        if tag in ("option", "optgroup", "hr"):
            if self.stack[-1].tag == "option":
                self.pop()
            if tag != "option" and self.stack[-1].tag == "optgroup":
                self.pop()
            self.insert(tag, attrs, keep=tag != "hr")
        elif tag in ("script", "template"):
            self.start_in_head(tag, attrs)
        elif tag in ("select", "input", "keygen", "textarea") or tag in (TABLE_PARTS | CELLS | {"caption"}) and self.at["table"]:
            self.pop_to("select")
            if tag != "select":
                self.start(tag, attrs, closed)

    def clear_to(self, context: str) -> None:
        while self.stack[-1].tag != context:
            self.pop()

    def start_in_table(self, context: str, tag: str, attrs: dict[str, str], closed: bool) -> bool:
        """Whether the tag is a table's own. A part that must lie in another one gets it, unless the stack is full."""
        again = lambda: self.start(tag, attrs, closed)
        if context in CELLS or context == "caption":
            if tag not in STRUCTURE:
                return False
            self.pop_to(context)
            self.unmark()
            again()
        elif context == "colgroup":
            if tag == "col":
                self.insert(tag, attrs, keep=False)
            else:
                self.clear_to(context)
                self.pop()
                again()
        elif tag in CELLS and context == "tr":
            self.clear_to(context)
            self.insert(tag, attrs)
            self.mark()
        elif tag in CELLS or tag == "tr" and context == "table":
            self.clear_to(context)
            if self.insert("tbody" if context == "table" else "tr", {}).open:
                again()
        elif tag == "tr" and context in GROUPS:
            self.clear_to(context)
            self.insert(tag, attrs)
        elif tag in STRUCTURE and context != "table":
            self.clear_to(context)
            self.pop()
            again()
        elif tag == "col":
            self.clear_to(context)
            if self.insert("colgroup", {}).open:
                again()
        elif tag in STRUCTURE:
            self.clear_to(context)
            if self.insert(tag, attrs).open and tag == "caption":
                self.mark()
        elif tag == "table":
            self.pop_to("table")
            again()
        elif tag in ("script", "style", "template"):
            self.start_in_head(tag, attrs)
        elif tag == "input" and attrs.get("type", "").lower() == "hidden":
            self.insert(tag, attrs, keep=False)
        elif tag == "form":
            if self.form is None:
                self.form = self.insert(tag, attrs, keep=False)
        else:
            return False
        return True

    def start_in_body(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        if tag == "body":
            if self.body is not None and self.body.tag == "body":
                for k, v in attrs.items():
                    self.body.attrs.setdefault(k, v)
        elif tag in IN_HEAD and tag != "noscript":
            self.start_in_head(tag, attrs)
        elif tag in STRUCTURE or tag in ("head", "frame", "frameset"):
            pass
        elif tag in BLOCKS or tag in HEADINGS or tag == "plaintext":
            self.close_p()
            if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
                self.pop()
            self.insert(tag, attrs)
        elif tag == "form":
            if self.form is None or self.at["template"]:
                self.close_p()
                node = self.insert(tag, attrs)
                if not self.at["template"]:
                    self.form = node
        elif tag in ("li", "dd", "dt"):
            same = ("li",) if tag == "li" else ("dd", "dt")
            for k in range(len(self.stack) - 1, 0, -1):
                open_ = self.stack[k].tag
                if open_ in same:
                    self.imply(open_)
                    self.pop_to(open_)
                    break
                if open_ in SPECIAL and open_ not in ("address", "div", "p"):
                    break
            self.close_p()
            self.insert(tag, attrs)
        elif tag == "table":
            self.close_p()
            self.insert(tag, attrs)
        elif tag == "hr":
            self.close_p()
            self.insert(tag, attrs, keep=False)
        elif tag in ("param", "source", "track"):
            self.insert(tag, attrs, keep=False)
        elif tag in RAW or tag == "textarea":
            if tag == "xmp":
                self.close_p()
                self.reopen()
            self.insert_raw(tag, attrs)
        elif tag in ("rb", "rtc", "rp", "rt"):
            if self.in_scope("ruby"):
                self.imply("rtc" if tag in ("rp", "rt") else "")
            self.insert(tag, attrs)
        else:
            self.start_phrase(tag, attrs, closed)

    def start_phrase(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        if tag in ("a", "nobr"):
            old = next((x for x in reversed(self.formats[last_index(self.formats, None) + 1 :]) if x.tag == tag), None)
            if old is not None and (tag == "a" or self.in_scope("nobr")):
                self.adopt(tag)
                if (i := last_index(self.formats, old)) >= 0:
                    del self.formats[i]
                if old.open:
                    self.restack([x for x in self.stack if x is not old])
        if tag in FORMATTING:
            self.format(tag, attrs)
            return
        if tag == "button" and self.in_scope("button"):
            self.imply()
            self.pop_to("button")
        if tag in ("option", "optgroup") and self.stack[-1].tag == "option":
            self.pop()
        self.reopen()
        foreign = tag in ("svg", "math")
        self.insert("img" if tag == "image" else tag, attrs, keep=not (tag in VOID or tag == "image" or foreign and closed))
        if tag in ("applet", "marquee", "object"):
            self.mark()

    # End tags

    def end(self, tag: str) -> None:
        if self.body is None and not self.at["template"]:
            if tag in ("body", "html", "br"):
                self.before_body("#", {})
            elif tag == "head" and self.head is None:
                self.head = self.insert("head", {}, keep=False)
            elif self.head is not None and self.head.open and (tag == "head" or self.stack[-1].tag == tag == "noscript"):
                self.pop_to(tag)
            if self.body is None:
                return
        if tag == "template":
            if self.at["template"]:
                self.pop_to(tag)
                self.unmark()
            return
        context = self.contexts[-1] if self.contexts else ""
        if context in ("svg", "math") and self.end_foreign(tag):
            return
        if context == "foreignobject" and tag == context:
            self.pop_to(tag)
        elif context == "select":
            self.end_in_select(tag)
        elif context == "frameset":
            if tag == "frameset" and len(self.at["frameset"]) > 1:
                self.pop()
        elif context in ("", "template", "foreignobject") or not self.end_in_table(context, tag):
            self.foster = context in TABLE_PARTS
            self.end_in_body(tag)
            self.foster = False

    def end_foreign(self, tag: str) -> bool:
        """Within a foreign element its own open elements may end; other names are the body's."""
        own = self.at.get(tag)
        if own and own[-1] >= max(self.at["svg"][-1:] + self.at["math"][-1:]):
            self.pop_to(tag)
            return True
        return tag not in ("p", "br") and not own

    def end_in_select(self, tag: str) -> None:
        if tag == "optgroup" and self.stack[-1].tag == "option" and self.stack[-2].tag == tag:
            self.pop()
        if tag in ("option", "optgroup") and self.stack[-1].tag == tag:
            self.pop()
        elif tag == "select":
            self.pop_to(tag)
        elif tag in TABLE_PARTS | CELLS | {"caption"} and self.in_scope(tag, TABLE_SCOPE):
            self.pop_to("select")
            self.end(tag)

    def end_in_table(self, context: str, tag: str) -> bool:
        """Whether the end tag is a table's own, or has no meaning there."""
        if context in CELLS or context == "caption":
            ends = TABLE_PARTS if context in CELLS else {"table"}
            if tag == context or tag in ends and self.in_scope(tag, TABLE_SCOPE):
                self.pop_to(context)
                self.unmark()
                if tag != context:
                    self.end(tag)
                return True
            return tag in STRUCTURE | TABLE_PARTS | {"body", "html"}
        if context == "colgroup":
            if tag != "col":
                self.clear_to(context)
                self.pop()
                if tag != context:
                    self.end(tag)
            return True
        if tag == "table":
            self.pop_to(tag)
            return True
        if tag == context or context == "tr" and tag in GROUPS and self.in_scope(tag, TABLE_SCOPE):
            self.clear_to(context)
            self.pop()
            if tag != context:
                self.end(tag)
            return True
        if context in GROUPS and tag in GROUPS and self.in_scope(tag, TABLE_SCOPE):
            self.clear_to(context)
            self.pop()
            return True
        return tag in STRUCTURE | {"body", "html"}

    def end_in_body(self, tag: str) -> None:
        if tag in ("body", "html"):
            return  # what follows still goes to the body
        if tag == "p":
            if not self.in_scope("p", BUTTON_SCOPE):
                self.insert("p", {})
            self.close_p()
        elif tag == "br":
            self.start_in_body("br", {}, False)
        elif tag in FORMATTING:
            if not self.adopt(tag):
                self.end_other(tag)
        elif tag == "form" and not self.at["template"]:
            node, self.form = self.form, None
            if node is not None and node.open and self.in_scope(tag):
                self.imply()
                self.restack([x for x in self.stack if x is not node])
        elif tag in HEADINGS:
            if any(self.in_scope(x) for x in HEADINGS):
                self.imply()
                self.pop_to(*HEADINGS)
        elif tag in BLOCKS or tag in ("button", "form", "li", "dd", "dt", "applet", "marquee", "object"):
            if self.in_scope(tag, LIST_SCOPE if tag == "li" else SCOPE):
                self.imply(tag if tag in ("li", "dd", "dt") else "")
                self.pop_to(tag)
                if tag in ("applet", "marquee", "object"):
                    self.unmark()
        else:
            self.end_other(tag)

    def end_other(self, tag: str) -> None:
        own = self.at.get(tag)
        if not own:
            return
        for k in range(len(self.stack) - 1, own[-1], -1):
            if self.stack[k].tag in SPECIAL:
                return
        self.pop_to(tag)

    # Texts

    def text(self, text: str) -> None:
        blank = not text.strip(SPACE)
        if self.body is None and not self.at["template"]:
            if blank:
                return
            self.before_body("#", {})
            text = text.lstrip(SPACE)
        context = self.contexts[-1] if self.contexts else ""
        if context == "colgroup" and not blank:
            self.clear_to(context)
            self.pop()
            return self.text(text)
        if context == "frameset":
            return None
        if not (context in TABLE_PARTS and blank):
            self.foster = context in TABLE_PARTS
            if context not in ("svg", "math", "select", "colgroup"):
                self.reopen()
        self.insert_text(text)
        self.foster = False
        return None
