"""Responses to page records: one parse of a body gives every column, nested array and DOM fact that rules and exports need.

A body becomes the tree that the HTML standard gives it (tree.py), whatever it holds: no body fails, and the time is linear in
its length. Of a plain body, whose tags nest as they are written, the same facts are taken in one pass over its tags, without a
tree (`Facts.plain`); the first thing in it that is not plain leads to the tree. Defined results: a null body or url is an empty one, null headers are none, a null status is 0."""

from __future__ import annotations

import hashlib
import html as entities
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.functions.urls import Resolver, resolve
from auditlake.sources.tree import BLOCKS, COMMENT_END, FORMATTING, HEADINGS, MARKUP, SPACE, SPECIAL, Node, Tree, attribute_text, attributes, names

MOST_BODY = 10 << 20
#: Lists of facts, and the elements whose ends the walk must see.
FOUND = (
    "title title_source description descriptions canonical refresh robots h1 h2 alternate hreflang links images sources iframes audios videos scripts "
    "styles headings forms pagination viewport csp base preload css body_meta head"
).split()
#: Of pictures, or players, that lie in each other a source counts for so many of the innermost ones.
NESTED = 4
LEFT = frozenset("a title h1 h2 style picture audio video body head".split())
HTML_TYPES = ("text/html", "application/xhtml+xml", "application/vnd.wap.xhtml+xml")
LINK = "struct<url:string,rel:string,text:string,external:boolean,nofollow:boolean,sponsored:boolean,ugc:boolean,status_code:int>"
DOM = (
    "struct<n_head_canonical:int,first_canonical_href:string,n_head_title:int,title_source:string,n_head_meta_description:int,n_body_child_meta:int,n_elements:int,has_duplicate_id:boolean,heading_levels:array<int>,form_actions:array<string>,picture_without_img:boolean,"
    "img_missing_size:boolean,alternate_hrefs:array<string>,pagination_hrefs:array<string>,viewport_content:string,has_csp_meta:boolean,base_href:string,preload_hrefs:array<string>,css_urls:array<string>>"
)
RECORD = (
    "crawl_id bigint, url string, scheme string, status_code int, redirect_url string, refresh string, content_type string, media_type string, lang string, title string, description string, robots string, noindex boolean, nofollow boolean, canonical string, h1 string, h2 string, words int, size bigint, "
    "body_hash string, robotstxt_blocked boolean, crawled boolean, in_sitemap boolean, timeout boolean, depth int, ttfb int, "
    f"links array<{LINK}>, external_links array<{LINK}>, internal_links array<{LINK}>, hreflangs array<struct<url:string,lang:string>>, images array<struct<url:string,alt:string>>, scripts array<string>, styles array<string>, iframes array<string>, audios array<string>, videos array<struct<url:string,poster:string>>, headers map<string,array<string>>, dom {DOM}"
)


CANDIDATE = re.compile(r"[\s,]*(\S+)")


def srcset(value: str) -> list[str]:
    """URLs of a srcset: white space ends a URL, a comma after its descriptor ends the entry; commas may lie inside URLs."""
    out, at, value = [], 0, value.strip(" ,")
    while at < len(value):
        m = CANDIDATE.match(value, at)
        if not m:
            break
        word, at = m[1], m.end()
        if word.endswith(","):
            word = word.rstrip(",")
        else:
            stop = value.find(",", at)
            at = len(value) if stop < 0 else stop + 1
        if word:
            out.append(word)
    return out


#: A tag whose attributes are plainly written, and the text behind it; or a "<" of anything else, and what follows it.
TOKENS = re.compile(
    r"""<(?:(/?)([A-Za-z][A-Za-z0-9-]*+)((?:[\t\n\f ]++[A-Za-z_:][A-Za-z0-9_:.-]*+(?:=(?:"[^"]*+"|'[^']*+'|[^\t\n\f "'>=<`]++))?+)*+)[\t\n\f ]*+/?>|)([^<]*+)"""
)
GIVEN = re.compile(r"""([A-Za-z_:][A-Za-z0-9_:.-]*+)(?:=(?:"([^"]*+)"|'([^']*+)'|([^\t\n\f "'>=<`]++)))?+""")
#: Longer bodies go to the tree, so that not all of their tags are held at once.
MOST_PLAIN = 1 << 20
#: So many elements may be open in a plain body.
PLAIN_DEPTH = 500
# Elements of a plain body: those without content, of text alone, that end an open <p>, and that the tree alone knows how to place.
PLAIN_HEAD, PLAIN_VOID = names("base link meta"), names("area base br embed img input link meta param source track wbr")
PLAIN_RAW, ENDS_P = names("iframe script style title"), BLOCKS | HEADINGS | {"form", "hr", "li", "dd", "dt"}
ITEMS = {"li": names("li"), "dd": names("dd dt"), "dt": names("dd dt")}
NOT_PLAIN = names(
    "applet basefont bgsound body caption col colgroup foreignobject frame frameset head html image keygen listing marquee math nobr noembed noframes noscript object optgroup option "
    "plaintext pre rb rp rt rtc ruby select svg table tbody td template textarea tfoot th thead tr xmp"
)
#: What a start tag in a plain body does, by its name; 0 for all other names: it opens an element.
OPENS, ENTERS, ENDS, ALONE, HOLDS_TEXT, ODD = range(6)
PLAIN = (
    dict.fromkeys(names("a audio button picture video"), ENTERS) | dict.fromkeys(ENDS_P, ENDS) | dict.fromkeys(PLAIN_VOID, ALONE) | dict.fromkeys(PLAIN_RAW, HOLDS_TEXT) | dict.fromkeys(NOT_PLAIN, ODD)
    | dict.fromkeys(FORMATTING - names("a nobr") | {"span"}, OPENS)
)
NOTHING: dict[str, str] = {}


@lru_cache(4096)
def given(written: str) -> dict[str, str]:
    """Plainly written attributes; the first of a name counts. The dict is shared, so nobody may change it."""
    found: dict[str, str] = {}
    for name, double, single, bare in GIVEN.findall(written):
        found.setdefault(name.lower(), attribute_text(double or single or bare))
    return found


class Facts:
    """What the columns and rules need of a document, in document order."""

    def __init__(self, body: str):
        body = body.replace("\r\n", "\n").replace("\r", "\n") if "\r" in body else body
        self.clear()
        if len(body) > MOST_PLAIN or not self.plain(body):
            self.clear()
            self.walk(Tree(body))
        self.same_ids = len(set(self.ids)) < len(self.ids)

    def clear(self) -> None:
        self.f: dict[str, list] = {k: [] for k in FOUND}
        self.texts: list[str] = []
        self.words: list[str] = []
        self.ids: list[str] = []
        self.n_elements, self.in_link, self.in_body = 0, 0, 0
        self.missing_size = self.bare_picture = False
        self.media: list[tuple[str, list]] = []
        self.pictures: list[dict] = []
        self.lang = ""

    def walk(self, tree: Tree) -> None:
        """Over the tree in document order."""
        self.lang = tree.root.attrs.get("lang", "")
        todo: list = [tree.root]
        while todo:
            x = todo.pop()
            if isinstance(x, Node):
                self.begin(x.tag, x.attrs, x.up is not None and x.up is tree.head, x.up is not None and x.up is tree.body)
                if x.tag in LEFT:
                    todo.append((x, len(self.texts), len(self.f["links"])))
                counts = x.tag != "script"
                todo += [y if isinstance(y, Node) else (y, counts) for y in reversed(x.kids) if y is not None]
            elif len(x) == 2:
                text = "".join(x[0])
                self.texts.append(text)
                if self.in_body and not self.in_link and x[1]:
                    self.words.append(text)
            else:
                x, texts, links = x
                self.leave(x.tag, x.attrs, texts, links, x.source if x.up is tree.head else None)

    def plain(self, body: str) -> bool:
        """The facts from the tags as they are written; False where the tree could be another one, and what was found is void."""
        first = body.find("<")
        if first < 0 or body[:first].strip(SPACE):
            return False
        tokens = iter(TOKENS.findall(body, first))
        return self.plain_head(tokens) and self.plain_body(tokens)

    def plain_head(self, tokens: Iterator[tuple[str, str, str, str]]) -> bool:
        """Up to <body>: a doctype, <html>, <head> and its children, </head>."""
        root = head = False
        for slash, tag, written, text in tokens:
            tag = tag.lower()
            if not tag:
                _, end, text = text.partition(">")
                if root or not end or _[:8].lower() != "!doctype":
                    return False
            elif slash:
                if tag != "head" or not head:
                    return False
                break
            elif not head:
                if tag == "html" and not root:
                    root = True
                    self.begin(tag, given(written))
                    self.lang = given(written).get("lang", "")
                elif tag == "head" and root:
                    head = True
                    self.begin(tag, given(written))
                else:
                    return False
            elif tag in PLAIN_HEAD:
                self.begin(tag, given(written), True)
            elif tag in PLAIN_RAW and tag != "iframe":
                self.begin(tag, given(written), True)
                end = next(tokens, None)
                if end is None or not end[0] or end[1].lower() != tag:
                    return False
                self.raw(tag, text, True)
                text = end[3]
            else:
                return False
            if text and text.strip(SPACE):
                return False
        else:
            return False
        self.f["head"].clear()
        slash, tag, written, after = next(tokens, ("", "", "", ""))
        if slash or tag.lower() != "body" or text.strip(SPACE):
            return False
        self.begin("body", given(written))
        if after:
            self.plain_text(after)
        return True

    def raw(self, tag: str, text: str, in_head: bool) -> None:
        """An element of text alone, to its end."""
        texts, source = len(self.texts), text
        if text:
            if tag == "title" and "&" in text:
                text = entities.unescape(text)
            self.texts.append(text)
            if self.in_body and not self.in_link and tag != "script":
                self.words.append(text)
        if tag in LEFT:
            self.leave(tag, NOTHING, texts, 0, source if in_head else None)

    def plain_text(self, text: str) -> None:
        if "&" in text:
            text = entities.unescape(text)
        self.texts.append(text)
        if not self.in_link:
            self.words.append(text)

    def plain_body(self, tokens: Iterator[tuple[str, str, str, str]]) -> bool:
        """Behind <body>: elements that end where they are the innermost open ones."""
        stack, marks, in_form = ["body"], [], False
        texts, words, links = self.texts, self.words, self.f["links"]
        p = 0  # open ones
        for slash, tag, written, text in tokens:
            if slash:
                if stack[-1] != tag and stack[-1] != (tag := tag.lower()):
                    return tag in ("body", "html") and len(stack) == 1 and self.plain_end(text, tokens)
                if tag == "body":
                    return len(stack) == 1 and self.plain_end(text, tokens)
                stack.pop()
                if tag in LEFT:
                    self.leave(tag, *marks.pop())
                elif tag == "p":
                    p -= 1
                elif tag == "form":
                    in_form = False
            elif not tag:
                if text[:3] != "!--" or text[3:4] == ">" or text[3:5] == "->" or not (end := COMMENT_END.search(text, 3)):
                    return False
                text = text[end.end() :]
            else:
                kind = PLAIN.get(tag)
                if kind is None:
                    tag = tag.lower()
                    kind = PLAIN.get(tag, OPENS)
                if kind == OPENS:
                    if written:
                        self.begin(tag, given(written))
                    else:
                        self.n_elements += 1
                    stack.append(tag)
                elif kind == ALONE:
                    self.begin(tag, given(written), False, len(stack) == 1)
                elif kind == ENTERS:
                    if tag == "a" and self.in_link or tag == "button" and tag in stack:
                        return False
                    a = given(written)
                    self.begin(tag, a)
                    stack.append(tag)
                    if tag in LEFT:
                        marks.append((a, len(texts), len(links)))
                elif kind == ENDS:
                    if p:
                        if stack[-1] != "p":
                            return False
                        stack.pop()
                        p -= 1
                    if tag in ITEMS:
                        if stack[-1] in ITEMS[tag]:
                            stack.pop()
                        elif stack[-1] not in SPECIAL or stack[-1] in ("address", "div"):
                            return False
                    elif tag == "p":
                        p += 1
                    elif tag == "form":
                        if in_form:
                            return False
                        in_form = True
                    elif tag in HEADINGS and stack[-1] in HEADINGS:
                        return False
                    a = given(written)
                    self.begin(tag, a)
                    if tag != "hr":
                        stack.append(tag)
                    if tag in LEFT:
                        marks.append((a, len(texts), len(links)))
                elif kind == HOLDS_TEXT:
                    self.begin(tag, given(written))
                    end = next(tokens, None)
                    if end is None or not end[0] or end[1].lower() != tag:
                        return False
                    self.raw(tag, text, False)
                    text = end[3]
                else:
                    return False
                if len(stack) > PLAIN_DEPTH:
                    return False
            if text:
                if "&" in text:
                    text = entities.unescape(text)
                texts.append(text)
                if not self.in_link:
                    words.append(text)
        return len(stack) == 1

    def plain_end(self, text: str, tokens: Iterator[tuple[str, str, str, str]]) -> bool:
        """Behind </body> nothing but </html> and white space."""
        return not text.strip(SPACE) and all(x[0] and x[1].lower() in ("body", "html") and not x[3].strip(SPACE) for x in tokens)

    def begin(self, tag: str, a: dict[str, str], in_head: bool = False, in_body: bool = False) -> None:
        f = self.f
        self.n_elements += 1
        if a:
            if a.get("id"):
                self.ids.append(a["id"])
            if a.get("style"):
                f["css"] += css_urls(a["style"])
            if in_head:
                self.enter_head(tag, a)
        if tag == "a":
            self.in_link += 1
            if "href" in a:
                f["links"].append(None)  # its place; the text is known when it ends
        elif tag == "meta":
            under = in_head or f["head"]  # below <head>, at any depth
            if under and a.get("name") == "description":
                f["descriptions"].append(1)
            if under and a.get("http-equiv") == "refresh" and "content" in a:
                f["refresh"].append(a["content"])
            if in_body:
                f["body_meta"].append(1)
        elif tag == "link":
            if a.get("rel") == "stylesheet" and "href" in a:
                f["styles"].append(a["href"])
        elif tag == "script":
            if "src" in a:
                f["scripts"].append(a["src"])
        elif tag == "iframe":
            if a.get("src"):
                f["iframes"].append(a["src"])
        elif tag == "form":
            f["forms"].append(a.get("action", ""))
        elif tag == "img":
            self.missing_size |= not (a.get("width") and a.get("height"))
            alt = a.get("alt", "")
            if a.get("src"):
                f["images"].append((a["src"], alt))
                f["images"] += [(u, alt) for u in srcset(a.get("srcset", ""))]
            for p in self.pictures:
                if p["alt"] is None:
                    p["alt"] = alt
        elif tag == "picture":
            self.pictures.append({"alt": None, "sets": []})
        elif tag == "source":
            urls = srcset(a.get("srcset", "")) if self.pictures else []
            for p in self.pictures[-NESTED:]:
                p["sets"] += urls
            for _, srcs in self.media[-NESTED:]:
                srcs.append(a.get("src", ""))
        elif tag in ("audio", "video"):
            self.media.append((a.get("poster", ""), [a["src"]] if a.get("src", "").strip() else []))
        elif tag in HEADINGS and self.in_body:
            f["headings"].append(int(tag[1]) - 1)
        elif tag == "body":
            self.in_body += 1
        elif tag == "head":
            f["head"].append(1)

    def enter_head(self, tag: str, a: dict[str, str]) -> None:
        """Children of <head>."""
        f, rel = self.f, a.get("rel", "")
        if tag == "base" and "href" in a:
            f["base"].append(a["href"])
        elif tag == "meta":
            if a.get("name") in ("description", "robots") and "content" in a:
                f[a["name"]].append(a["content"])
            if a.get("name") == "viewport":
                f["viewport"].append(a.get("content", ""))
            if a.get("http-equiv") == "Content-Security-Policy":
                f["csp"].append(1)
        elif tag == "link":
            if rel == "alternate":
                f["alternate"].append(a.get("href", ""))
                if "hreflang" in a:
                    f["hreflang"].append((a.get("href", ""), a["hreflang"]))
            elif "href" in a and rel in ("canonical", "next", "prev", "previous", "preload"):
                f[rel if rel in ("canonical", "preload") else "pagination"].append(a["href"])

    def leave(self, tag: str, a: dict[str, str], texts: int, links: int, source: str | None = None) -> None:
        """The end of an element of LEFT, which began at these places of the texts and the links. source: that of a child of <head>."""
        f = self.f
        text = lambda: "".join(self.texts[texts:])
        if tag == "a":
            self.in_link -= 1
            if "href" in a:
                f["links"][links - 1] = (a["href"], a.get("rel", "").strip(), text().strip())
        elif tag == "title":
            if source is not None:
                f["title"].append(text())
                f["title_source"].append(source)
        elif tag in ("h1", "h2"):
            f[tag].append((texts, text()) if not f[tag] or texts < f[tag][0][0] else (texts, ""))
        elif tag == "style":
            f["css"] += css_urls(text())
        elif tag == "picture":
            p = self.pictures.pop()
            self.bare_picture |= p["alt"] is None
            if p["alt"] is not None:
                f["sources"] += [(u, p["alt"]) for u in p["sets"]]
        elif tag in ("audio", "video"):
            poster, srcs = self.media.pop()
            f[tag + "s"] += [(u, poster) for u in srcs] if tag == "video" else srcs
        elif tag == "body":
            self.in_body -= 1
        elif tag == "head":
            f["head"].clear()

    def heading(self, tag: str) -> str:
        """The text of the first element of that name, in document order."""
        return sanitised(min(self.f[tag])[1]).strip() if self.f[tag] else ""


def css_urls(css: str) -> list[str]:
    return [x.strip("'\" \t\n") for x in re.findall(r"url\((.*?)\)", css)]


class _Spaced(dict):
    """For str.translate: punctuation and symbols become spaces."""

    def __missing__(self, code: int) -> int:
        self[code] = 32 if unicodedata.category(chr(code))[0] in "PS" else code
        return self[code]


SPACED = _Spaced()


def count_words(texts: list[str]) -> int:
    return len(" ".join(texts).translate(SPACED).split())


#: Elements whose content a strict policy drops with them, and how it writes the five characters.
DROPPED = frozenset("frame frameset iframe noembed noframes noscript nostyle object script style".split())
ESCAPES = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&#34;", "'": "&#39;"})


def sanitised(text: str) -> str:
    """A text without any markup: tags and comments go, and what `DROPPED` elements hold; what stays is escaped."""
    if "<" not in text:
        return entities.unescape(text).translate(ESCAPES) if "&" in text else text.translate(ESCAPES)
    out, at, dropped = [], 0, 0
    while at < len(text):
        m = MARKUP.search(text, at)
        stop = m.start() if m else len(text)
        if not dropped:
            out.append(entities.unescape(text[at:stop]))
        if not m:
            break
        if not m[2]:
            end = text.find("-->" if m[3] else ">", m.end() if m[3] else m.start())
            at = len(text) if end < 0 else end + (3 if m[3] else 1)
            continue
        tag, closed, at = m[2].lower(), *attributes(text, m.end())[1:]
        if tag in DROPPED and not closed:
            dropped = max(0, dropped + (-1 if m[1] else 1))
        if at < 0:
            break
    return "".join(out).translate(ESCAPES)


def link_header(values: list[str]) -> list[tuple[str, list[str]]]:
    out = []
    for entry in ",".join(values).split(","):
        url, *params = [x.strip() for x in entry.split(";")]
        if url.startswith("<") and url.endswith(">"):
            out.append((url[1:-1], params))
    return out


#: Names that browsers give to other character sets than their own.
CHARSETS = {
    "iso-8859-1": "cp1252",
    "latin1": "cp1252",
    "ascii": "cp1252",
    "us-ascii": "cp1252",
    "iso-8859-9": "cp1254",
    "shift_jis": "cp932",
    "sjis": "cp932",
    "gb2312": "gb18030",
    "gbk": "gb18030",
    "euc-kr": "cp949",
    "ks_c_5601-1987": "cp949",
    "tis-620": "cp874",
}
META_CHARSET = re.compile(rb"""<meta\s[^>]*?charset\s*=\s*["']?\s*([A-Za-z0-9_:.-]+)""", re.I)


def decode(body: bytes, content_type: str) -> str:
    """The text of a body: by its byte order mark, the Content-Type's charset, a <meta> among the first 1024 bytes, or else as
    UTF-8 if it is valid, as windows-1252 if not."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xfe\xff", "utf-16-be"), (b"\xff\xfe", "utf-16-le")):
        if body.startswith(mark):
            return body[len(mark) :].decode(name, "replace")
    named = re.search(r"charset\s*=\s*[\"']?\s*([^\s\"';,]+)", content_type, re.I)
    meta = META_CHARSET.search(body[:1024])
    for label in (named and named[1], meta and meta[1].decode()):
        if label:
            name = CHARSETS.get(label.lower(), label.lower())
            try:
                # a <meta> that could be read as ASCII cannot be in UTF-16
                return body.decode("utf-8" if label is not (named and named[1]) and name.startswith("utf-16") else name, "replace")
            except LookupError:
                continue
    try:
        return body.decode("utf-8")
    except UnicodeDecodeError as e:
        # a character that is cut off at the end is no sign of another character set
        return body.decode("utf-8", "replace") if e.start >= len(body) - 3 and e.reason == "unexpected end of data" else body.decode("cp1252", "replace")


EMPTY_TEXTS = dict.fromkeys("redirect_url refresh lang title description robots canonical h1 h2 body_hash".split(), "")
EMPTY_LISTS = "links external_links internal_links hreflangs images scripts styles iframes audios videos".split()
#: Columns of elements without which they are empty, as those begin in a body in lower case.
STARTS = {"images": ("<img", "<image"), "scripts": ("<script",), "styles": ("<link",), "iframes": ("<iframe",), "audios": ("<audio",), "videos": ("<video",)}
#: Columns that are read off the response.
OF_RESPONSE = frozenset(
    "crawl_id url scheme status_code content_type media_type size headers body_hash robotstxt_blocked in_sitemap timeout depth ttfb".split()
)
ORIGIN = re.compile(r"[a-z]+://([^/?#]*)")


def needs_facts(wanted: frozenset[str] | None, text: str) -> bool:
    """Whether a body can hold anything of the wanted columns."""
    if wanted is None or not wanted <= STARTS.keys() | OF_RESPONSE:
        return True
    lower = text.lower()
    return any(start in lower for column in wanted & STARTS.keys() for start in STARTS[column])


def parse(r: dict, wanted: frozenset[str] | None = None) -> dict:
    """A page record of one response, as a dict of RECORD's columns (without the keys that are copied). wanted: columns that must
    be right, all where not given; others may be empty."""
    want = lambda *columns: wanted is None or not wanted.isdisjoint(columns)
    headers = {k.lower(): list(v or []) for k, v in (r.get("headers") or {}).items()}
    first = lambda k: (headers.get(k) or [""])[0]
    body = (r.get("body") or "").encode()[:MOST_BODY]
    url, status = r["url"] or "", r.get("status_code") or 0
    kind = first("content-type")
    size = len(body) or r.get("content_length") or 0
    out = {
        "scheme": url.partition("://")[0], "content_type": kind, "media_type": kind.split(";")[0].strip().lower(), "size": size, "headers": headers,
        **EMPTY_TEXTS, "noindex": False, "nofollow": False, "words": 0,
        **{k: [] for k in EMPTY_LISTS},
    }
    if want("dom"):
        out["dom"] = dom = {
            "n_head_canonical": 0,
            "first_canonical_href": "",
            "n_head_title": 0,
            "title_source": "",
            "n_head_meta_description": 0,
            "n_body_child_meta": 0,
            "n_elements": 0,
            "has_duplicate_id": False,
            "heading_levels": [],
            "form_actions": [],
            "picture_without_img": False,
            "img_missing_size": False,
            "alternate_hrefs": [],
            "pagination_hrefs": [],
            "viewport_content": None,
            "has_csp_meta": False,
            "base_href": None,
            "preload_hrefs": [],
            "css_urls": [],
        }
    if 300 <= status <= 399:
        out["redirect_url"] = resolve(first("location"), url) or ""
        return out
    text = body.decode("utf-8", "replace")
    if out["media_type"] == "text/css" and want("dom"):
        dom["css_urls"] = [u for x in css_urls(text) if (u := resolve(x, url))]
    if not any(x in kind for x in HTML_TYPES) or not size:
        return out
    if want("body_hash"):
        out["body_hash"] = hashlib.sha256(body).hexdigest()
    if not needs_facts(wanted, text):
        return out
    p = Facts(text)
    f = p.f
    base = f["base"][0] if f["base"] else None
    to = Resolver(url, base)
    absolute = lambda refs: [u for x in refs if (u := to(x))]
    one = lambda k: f[k][0].strip() if f[k] else ""
    robots = one("robots") or first("x-robots-tag")
    header_links = link_header(headers["link"]) if "link" in headers else []
    out |= {
        "lang": p.lang or first("content-language"), "title": one("title"), "description": one("description"),
        "robots": robots, "noindex": "noindex" in robots or "none" in robots, "nofollow": "nofollow" in robots or "none" in robots,
    }
    if want("refresh", "redirect_url"):
        out["refresh"] = refresh = one("refresh")
        part = refresh.split(";")[1] if ";" in refresh else ""
        out["redirect_url"] = (to(part[4:].replace("'", "")) or "") if part[:4].lower() == "url=" else ""
    if want("canonical"):
        # one tag that can be resolved, or else the header
        canonical = (to(f["canonical"][0]) or "") if len(f["canonical"]) == 1 else ""
        if not canonical:
            named = next((u for u, ps in header_links if len(ps) == 1 and 'rel="canonical"' in ps[0]), "")
            canonical = (to(named) or "") if named else ""
        out["canonical"] = canonical
    if want("h1", "h2"):
        out |= {"h1": p.heading("h1"), "h2": p.heading("h2")}
    if want("words"):
        out["words"] = count_words(p.words)
    if want("links", "external_links"):
        host = m[1] if (m := ORIGIN.match(url)) else url
        for ref, rel, label in f["links"]:
            if target := to(ref):
                external = (m[1] if (m := ORIGIN.match(target)) else target) != host
                out["external_links" if external else "links"].append(
                    {
                        "url": target,
                        "rel": rel,
                        "text": sanitised(label),
                        "external": external,
                        "nofollow": "nofollow" in rel,
                        "sponsored": "sponsored" in rel,
                        "ugc": "ugc" in rel,
                        "status_code": None,
                    }
                )
    if want("hreflangs"):
        alternates = [{"url": u, "lang": lang} for x, lang in f["hreflang"] if (u := to(x))]
        if not alternates:
            for u, ps in header_links:
                langs = [x.split("=", 1)[1].strip('"') for x in ps if x.startswith("hreflang=")]
                if langs and any('rel="alternate"' in x for x in ps):
                    alternates.append({"url": u, "lang": langs[0]})
        out["hreflangs"] = alternates
    if want("images"):
        out["images"] = [{"url": u, "alt": alt} for x, alt in f["images"] + f["sources"] if (u := to(x))]
    if want("videos"):
        out["videos"] = [{"url": u, "poster": to(poster) or "" if poster else ""} for x, poster in f["videos"] if (u := to(x))]
    for column in ("scripts", "styles", "iframes", "audios"):
        if f[column] and want(column):
            out[column] = absolute(f[column])
    if want("dom"):
        plain = Resolver(url)
        out["dom"] = dom | {
            "n_head_canonical": len(f["canonical"]), "first_canonical_href": f["canonical"][0] if f["canonical"] else "", "n_head_title": len(f["title"]), "title_source": f["title_source"][0] if f["title_source"] else "", "n_head_meta_description": len(f["descriptions"]), "n_body_child_meta": len(f["body_meta"]),
            "n_elements": p.n_elements, "has_duplicate_id": p.same_ids, "heading_levels": f["headings"], "form_actions": f["forms"], "picture_without_img": p.bare_picture, "img_missing_size": p.missing_size,
            "alternate_hrefs": f["alternate"], "pagination_hrefs": absolute(f["pagination"]), "viewport_content": f["viewport"][0] if f["viewport"] else None, "has_csp_meta": bool(f["csp"]), "base_href": base, "preload_hrefs": absolute(f["preload"]), "css_urls": [
                u for x in f["css"] if (u := plain(x))
            ],
        }
    return out


#: The source row: what a fetch gives.
RESPONSE = "crawl_id bigint, url string, status_code int, headers map<string,array<string>>, body string, content_length bigint, ttfb int, depth int, in_sitemap boolean, robotstxt_blocked boolean, timeout boolean"


#: Headers, and the columns that are read off them where that is not all.
READ_HEADERS = {
    "content-type": None, "location": {"redirect_url"}, "link": {"canonical", "hreflangs"}, "content-language": {"lang"}, "x-robots-tag": {"robots", "noindex", "nofollow"},
}


def header_maps(column: pa.MapArray) -> list[dict[str, list[str]]]:
    """The headers of a batch's responses; a null one has none."""
    if column.items.null_count:
        return [dict(x or []) for x in column.to_pylist()]
    keys, values = column.keys.to_pylist(), column.items.values.to_pylist()
    ends = column.items.offsets.to_pylist()
    lists = [values[a:b] for a, b in zip(ends, ends[1:])]
    at = column.offsets.to_pylist()
    return [dict(zip(keys[a:b], lists[a:b])) for a, b in zip(at, at[1:])]


def page_records(responses: DataFrame, follow_nofollow: bool = False, include_noindex: bool = True, tasks: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """RECORD rows; a page is crawled unless it timed out or asks not to be followed. Noindex pages may be left out.

    tasks: deal the responses out to so many tasks first, by a hash of their URL: for inputs of a few large splits, as parsing
    takes far longer than reading. columns: those of RECORD that are wanted, all where not given."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = T._parse_datatype_string(RECORD)
    if columns is not None:
        kind = T.StructType([x for x in kind if x.name in columns])
    schema = to_arrow_schema(kind)
    # what is copied is read only where it is wanted
    flags = [k for k in ("in_sitemap", "robotstxt_blocked", "timeout") if k in schema.names or k == "timeout" and "crawled" in schema.names]
    copied = [k for k in ("crawl_id", "depth", "ttfb") if k in schema.names]
    needed = {"url", "status_code", "headers", "body", "content_length", *flags, *copied}
    read = [k for x in RESPONSE.replace("map<string,array<string>>", "map").split(", ") if (k := x.split()[0]) in needed]
    wanted = None if columns is None else frozenset(schema.names) | ({"nofollow"} if "crawled" in schema.names else set()) | (set() if include_noindex else {"noindex"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            headers = header_maps(batch.column("headers"))
            rest = batch.drop_columns("headers")
            for at in range(0, batch.num_rows, 256):
                yield of_slice(rest.slice(at, 256), headers[at : at + 256])

    def of_slice(batch: pa.RecordBatch, headers: list[dict[str, list[str]]]) -> pa.RecordBatch:
        rows = []
        for r, r["headers"] in zip(batch.to_pylist(), headers):
            page = parse(r, wanted)
            for k in copied:
                page[k] = r[k]
            for k in flags:
                page[k] = bool(r[k])
            page["url"], page["status_code"] = r["url"], r["status_code"] or 0
            if "crawled" in schema.names:
                page["crawled"] = not page["timeout"] and (follow_nofollow or not page["nofollow"])
            if "headers" in schema.names:
                page["headers"] = list(page["headers"].items())
            if include_noindex or not page["noindex"]:
                rows.append(page)
        return pa.RecordBatch.from_pylist(rows, schema)

    if wanted is not None and "headers" not in wanted:
        asked = [k for k, of in READ_HEADERS.items() if of is None or wanted & of]
        responses = responses.withColumn("headers", F.map_filter("headers", lambda k, _: F.lower(k).isin(asked)))
    dealt = responses.select(*read)
    if tasks:
        dealt = dealt.repartition(tasks, F.xxhash64("url"))
    return dealt.mapInArrow(run, kind)
