"""Secret scans: fixed patterns, and dictionary-primed zstandard novelty.

Novelty finds what no pattern names. Around a word that speaks of secrets, on either side and over line ends, each long enough
string of secret-like characters is a candidate; so is the whole body of a PEM block of a private key. It is compressed behind its surrounding text with a compressor primed with a dictionary of code identifiers;
the bytes that it adds beyond the surroundings alone, as a share of what random strings of its length over its own character
classes add in the same place, are its novelty. Words, identifiers and repeated names are found in the dictionary or the
surroundings and add little; a random string adds about as much as others of its classes, and is reported.
A candidate that overlaps a pattern's span is already known.

Offsets are code points, end exclusive. Defined results: a null or empty text has no spans; texts of any length are searched
whole; of equal starts the kinds come in the order assign, access, hex, novel; repeated rows are scanned each; an empty table
gives no rows; columns besides doc_id and text are not read."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from auditlake.llm import text as tx

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A maximal run of 32 or more is what is left of [0-9a-f]+ when shorter matches are dropped.
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "novel")
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
SENSITIVE_WORDS = (
    *ASSIGN_WORDS,
    "pwd",
    "credential",
    "private",
    "bearer",
    "authoriz",
    "api-key",
    "access_key",
    "access-key",
    "accesskey",
    "auth_",
    "auth-",
    "signature",
    "client_id",
    "conn_str",
    "connection_string",
)
SENSITIVE = re.compile("|".join(map(re.escape, sorted(SENSITIVE_WORDS, key=len, reverse=True))), re.ASCII | re.IGNORECASE)
#: '=' only ends a candidate: in front of a value it stands for an assignment.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.~-]{16,}={0,2}")
CANDIDATE_CHARACTER = re.compile(r"[A-Za-z0-9+/_.~-]")
PEM_BEGIN, PEM_LABEL, KEY = "-----BEGIN ", re.compile(r"[A-Z0-9 ]*"), "PRIVATE KEY"
PEM_BODY = re.compile(r"[A-Za-z0-9+/=\s\\]*")
#: Character classes, narrowest first: a candidate's alphabet is the first that holds its letters and digits, and its signs.
CLASSES = (
    "0123456789",
    "0123456789abcdef",
    "0123456789ABCDEF",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "0123456789abcdefghijklmnopqrstuvwxyz",
    "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ",
)
#: Identifiers that source files and configurations share.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key private_key public_key client_id client_secret credential authorization bearer basic signature "
    "connection_string username hostname localhost example.com default config settings environment production development staging testing "
    "import from return function class def const let var public private protected static final void string integer boolean float double null none true false self this "
    "http https www index html json yaml xml csv path file name value key data type size length count list dict array object request response header content "
    "get set put post delete update insert select where order group limit server client user admin account session cookie database table column schema "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ xxxxxxxxxxxxxxxx ................ ---------------- ================ ________________ 0000000000000000"
)

#: Parts that long words of prose are made of.
WORD_PARTS = (
    "ational ization isation ition ution ically istic alistic logical graphical ability ibility fulness lessness ousness iveness mental ential ential uous eous ious ative itive "
    "ingly edly ently antly ward wise ship hood ment ance ence ancy ency ture tude ology ography ometry onomy ectomy scope phone gram graph meter metric morph philia phobia "
    "inter intra trans super hyper counter under over multi micro macro electro photo thermo hydro psycho neuro cardio gastro immuno bio geo tele auto anti contra circum "
    "uncharacter incompre misunder disproport unconstitution revolution commun responsib represent administ industri institution national internation environment development "
    "character hensib compreh straight forward knowledge acknowledg interest particip consider understand transform inform perform confirm constru instru struct distrib "
    "temperat circumst opportun associ organiz recogn appreci investig demonstr concentr illustr identif classif specif simplif qualif modif justif "
    "schaft lichkeit igkeit heiten ungen keiten gesellschaft verantwort entwicklung wissenschaft bundes landes zusammen geschwindigkeit aux ement issement ellement amiento aciones imiento mente idades"
)


def alphabet(value: str) -> str:
    """What the characters of a random string like this one are drawn from."""
    plain = {c for c in value if c.isalnum() and c.isascii()}
    return next(x for x in CLASSES if plain <= set(x)) + "".join(sorted(set(value) - plain))


class Novelty:
    """least: share of a random string's added bytes from which a candidate is reported."""

    def __init__(self, identifiers: str = f"{WORD_PARTS} {IDENTIFIERS}", least: float = 0.9, around: int = 1024, reach: int = 1024):
        primed = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=6, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)
        self.least, self.around, self.reach = least, around, reach

    def added(self, surroundings: bytes, *candidates: str) -> list[int]:
        """Marginal compressed bytes of each candidate behind the surroundings."""
        alone = len(self.compressor.compress(surroundings))
        return [len(self.compressor.compress(surroundings + x.encode())) - alone for x in candidates]

    def share(self, surroundings: bytes, value: str, others: int = 4) -> float:
        """Added bytes of a candidate over the mean of random strings of its alphabet and length, the same each time."""
        letters, rng = alphabet(value), random.Random(len(value))
        own, *usual = self.added(surroundings, value, *["".join(rng.choices(letters, k=len(value))) for _ in range(others)])
        return own * others / max(1, sum(usual))

    def novel(self, text: str, start: int, end: int, value: str | None = None) -> bool:
        """Whether text[start:end], or the value in it, is novel behind what surrounds it."""
        behind = text[max(0, start - self.around) : start] + text[end : end + self.around]
        return self.share(behind.encode(), value or text[start:end]) >= self.least

    def spans(self, text: str, known: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
        """Bodies of private keys, then candidates up to `reach` characters before or behind a sensitive word; each is weighed once."""
        taken = sorted((s, e) for s, e, _ in known)
        blocks = []
        for start, end in key_bodies(text):
            value = re.sub(r"\s|\\[nr]", "", text[start:end])
            if len(value) >= 16 and self.novel(text, start, end, value):
                blocks.append((start, end))
        yield from blocks
        taken = sorted(taken + blocks)
        done = first = covered = 0
        for word in SENSITIVE.finditer(text):
            stop = word.end() + self.reach
            # a candidate that reaches into the window is taken whole; what is done is not looked at again
            at = max(done, word.start() - self.reach)
            while at > done and CANDIDATE_CHARACTER.match(text, at - 1):
                at -= 1
            while at <= stop and (begun := CANDIDATE.search(text, at, stop + 16)) and begun.start() <= stop:
                m = CANDIDATE.match(text, begun.start())
                at = m.end()
                # covered: the furthest end of the known spans that start before this candidate ends
                while first < len(taken) and taken[first][0] < m.end():
                    covered = max(covered, taken[first][1])
                    first += 1
                if covered <= m.start() and self.novel(text, m.start(), m.end()):
                    yield m.start(), m.end()
            # a run of 16 or more characters that starts up to `stop` has been met
            done = max(done, at, stop + 1)


def pem_mark(text: str, at: int) -> int:
    """The end of the first mark that begins a private key's block, from `at` on; -1 without one. Each label is read once."""
    while (at := text.find(PEM_BEGIN, at)) >= 0:
        at += len(PEM_BEGIN)
        label = PEM_LABEL.match(text, at)
        at, (head, key, tail) = label.end(), label[0].rpartition(KEY)
        if key and text.startswith("-----", at) and not any("0" <= c <= "9" for c in tail):
            return at + 5
    return -1


def key_bodies(text: str) -> Iterator[tuple[int, int]]:
    """Spans between the marks of private keys' PEM blocks; without an end mark, as far as base64 goes."""
    at, mark = 0, 0
    while (start := pem_mark(text, at)) >= 0:
        if 0 <= mark < start:
            mark = text.find("-----END ", start)
        end = mark
        if mark < 0 or text.find(PEM_BEGIN, start, mark) >= 0:
            end = PEM_BODY.match(text, start).end()
        at = max(end, start)
        body = text[start:end]
        yield start + len(body) - len(body.lstrip()), start + len(body.rstrip())


def base_spans(text: str, lower: str | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, leftmost and non-overlapping in each kind; failing matches are dropped."""
    lower = text.lower() if lower is None else lower
    found = []
    if any(w in lower for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def scan(text: str, novelty: Novelty) -> list[tuple[int, int, str]]:
    lower = text.lower()
    found = base_spans(text, lower)
    if any(w in lower for w in SENSITIVE_WORDS):
        found += [(s, e, "novel") for s, e in novelty.spans(text, found)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[secret]") -> str:
    out, at = [], 0
    for s, e, _ in spans:
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], mark]
        at = e
    return "".join([*out, text[at:]])


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string"


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    novelty = Novelty()
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for batch in batches:
        rows = []
        for text in batch.column(1):
            spans = scan(text.as_py() or "", novelty)
            kinds = [k for _, _, k in spans]
            base = joined([x for x in spans if x[2] != "novel"])
            rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), joined(spans)))
        columns = list(zip(*rows)) or [()] * 6
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64() if i < 4 else pa.string()) for i, c in enumerate(columns)]], names)


def find_secrets(docs: DataFrame) -> DataFrame:
    """Counts and spans of every row; see the module's text."""
    tx.arrow_batches(docs.sparkSession)
    return tx.only(docs, "doc_id", "text").mapInArrow(_scan_batches, SCHEMA)


def _redact_batches(batches: Iterator[pa.RecordBatch], names: list[str], text_at: int, size_at: int) -> Iterator[pa.RecordBatch]:
    novelty = Novelty()
    for batch in batches:
        columns, texts = list(batch.columns), []
        sizes = columns[size_at].to_pylist() if size_at >= 0 else None
        for i, value in enumerate(batch.column(text_at)):
            text = value.as_py()
            spans = scan(text, novelty) if text else []
            texts.append(redact(text, spans) if spans else text)
            if spans and sizes is not None:
                sizes[i] = len(texts[-1])
        columns[text_at] = pa.array(texts, columns[text_at].type)
        if sizes is not None:
            columns[size_at] = pa.array(sizes, columns[size_at].type)
        yield pa.RecordBatch.from_arrays(columns, names)


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with every span's text replaced by a mark; n_chars, where there is one, follows. Other texts are untouched."""
    tx.arrow_batches(docs.sparkSession)
    names = docs.columns
    size_at = names.index("n_chars") if "n_chars" in names else -1
    at = names.index("text")
    return docs.mapInArrow(lambda b: _redact_batches(b, names, at, size_at), T.StructType(docs.schema.fields))


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    return find_secrets(tx.table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays, its secrets replaced."""
    return redact_documents(docs)
