"""Personal data by anchor expansion.

One Aho-Corasick pass over a text (A-Z lower-cased, offsets unchanged) finds
anchors: at-signs, plus signs, schemes, and cues of accounts and street
addresses. Deterministic local parsers expand an anchor to both sides, check the
candidate and fix its boundaries. Runs of digits are their own anchors, for
network addresses and payment cards. Every parser moves over its neighbourhood
once, so the work is linear in the text however long it is.

Base kinds follow their patterns exactly, leftmost and non-overlapping:

    email   [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip      [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+), parts at most 255
    card    [0-9]([\\x20-]?[0-9])+, 16 to 19 digits passing Luhn
    phone   \\+[0-9][\\x20().0-9-]+[0-9], 8 to 15 digits

The method adds:

    account  an IBAN with right check digits, or 6 to 17 digits behind a cue
    address  a street with its house number, beside a cue such as "street"
    login    an address with user information behind a scheme, or one behind
             "mailto:" that is no base email
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflux.llm import common

KINDS = ("email", "ip", "card", "phone", "account", "address", "login")
BASE = KINDS[:4]

# Cues by the parser they start.
ACCOUNT_CUES = ("iban", "account", "acct", "konto", "cuenta", "compte")
STREET_AFTER = ("street", "avenue", "road", "lane", "boulevard", "straße", "strasse")  # name before, number on either side
STREET_BEFORE = ("calle", "avenida", "rue", "via")  # name behind, then the number
ANCHORS = {"@": "at", "+": "plus", "://": "scheme", "mailto:": "mail"} | {c: "account" for c in ACCOUNT_CUES} | {c: "after" for c in STREET_AFTER} | {c: "before" for c in STREET_BEFORE}

LOWER = {i: i + 32 for i in range(0x41, 0x5B)}
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# One-sign repeats only: a repeated group would keep a stack entry for every round.
FOUR = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
RUN = re.compile(r"[0-9][0-9\x20-]*")
GAP = re.compile(r"[\x20-]{2,}")
PHONE_RUN = re.compile(r"\+[0-9][\x20().0-9-]+")
IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:\x20?[A-Za-z0-9]){11,30}")
LINK = re.compile(r"[\x20\t]*(?:no\.?|number|nr\.?|num\.?|núm\.?|nummer|#)?[\x20\t]*[:=]?[\x20\t]*", re.IGNORECASE)
NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9]){5,16}(?![\x20-]?[0-9])")
HOUSE = re.compile(r"[0-9]{1,5}[A-Za-z]?(?![\w])")
WORD = re.compile(r"[^\W\d_][\w'’-]*")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban_end(text: str, at: int) -> int | None:
    """End of the longest prefix at `at` that is an IBAN: 15 to 34 signs, check digits right, not inside a word."""
    m = IBAN.match(text, at)
    if not m:
        return None
    ends, signs = [], []
    for i in range(at, m.end()):
        if text[i] != " ":
            signs.append(text[i].upper())
            if len(signs) >= 15 and not text[i + 1 : i + 2].isalnum():
                ends.append((i + 1, len(signs)))
    for end, n in reversed(ends):
        body = "".join(signs[4:n] + signs[:4])
        if body.isascii() and int("".join(str(int(c, 36)) for c in body)) % 97 == 1:
            return end
    return None


class Finder:
    """All spans of a text as (kind number, start, end), code points, end exclusive."""

    def __init__(self):
        import ahocorasick

        self.anchors = ahocorasick.Automaton()
        for cue, kind in ANCHORS.items():
            self.anchors.add_word(cue, (kind, len(cue)))
        self.anchors.make_automaton()

    def __call__(self, text: str) -> list[tuple[int, int, int]]:
        found: list[tuple[int, int, int]] = []
        last = dict.fromkeys(KINDS, 0)

        def add(kind: str, start: int, end: int) -> None:
            found.append((KINDS.index(kind), start, end))
            last[kind] = end

        self.digits(text, add)
        for at, (kind, size) in self.anchors.iter(text.translate(LOWER)):
            getattr(self, kind)(text, at - size + 1, at + 1, add, last)
        found.sort()
        return found

    def digits(self, text, add) -> None:
        if not any(map(text.__contains__, "0123456789")):
            return
        for run in RUN.finditer(text):
            if run.end() - run.start() < 16:
                continue
            begin = run.start()
            for gap in GAP.finditer(text, *run.span()):
                self.card(text, begin, gap.start(), add)
                begin = gap.end()
            self.card(text, begin, run.end(), add)
        if "." not in text:
            return
        for m in FOUR.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups()):
                add("ip", *m.span())

    def card(self, text, begin, end, add) -> None:
        """Digits with single separators between them; a separator may follow the last one."""
        if 16 <= end - begin <= 38:
            digits = text[begin:end].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                add("card", begin, end - (text[end - 1] in " -"))

    def at(self, text, begin, end, add, last) -> None:
        start = begin
        while start > last["email"] and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, end)
        if m and start < begin:
            add("email", start, m.end())

    def plus(self, text, begin, end, add, last) -> None:
        m = PHONE_RUN.match(text, begin)
        if not m:
            return
        stop = m.end()
        while not "0" <= text[stop - 1] <= "9":
            stop -= 1
        if stop - begin >= 4 and 8 <= sum("0" <= c <= "9" for c in text[begin:stop]) <= 15:
            add("phone", begin, stop)

    def scheme(self, text, begin, end, add, last) -> None:
        start = begin
        while start > last["login"] and (text[start - 1].isascii() and text[start - 1].isalnum()):
            start -= 1
        m = re.compile(r"[^\s/?#@<>\"']+@[A-Za-z0-9.-]*[A-Za-z0-9]").match(text, end)
        if m and start < begin and begin - start <= 20:
            add("login", start, m.end())

    def mail(self, text, begin, end, add, last) -> None:
        m = re.compile(r"[^\s<>\"':@]+@[\w-]+(?:\.[\w-]+)+").match(text, end)
        if m and not m.group().isascii():
            add("login", begin, m.end())

    def account(self, text, begin, end, add, last) -> None:
        if text[begin - 1 : begin].isalnum() or text[end : end + 1].isalnum() or begin < last["account"]:
            return
        at = LINK.match(text, end).end()
        stop = iban_end(text, at)
        if stop is None:
            m = NUMBER.match(text, at)
            if not m or text[m.end() : m.end() + 1].isalpha():
                return
            stop = m.end()
        add("account", at, stop)

    def after(self, text, begin, end, add, last) -> None:
        if text[end : end + 1].isalnum():
            return
        start = begin
        words = 0
        while start and (text[start - 1].isalnum() or text[start - 1] in " '-") and begin - start < 60 and words < 4:  # the name, one to three words
            start -= 1
            words += text[start] == " "
        before = re.compile(r"([0-9]{1,5}[A-Za-z]?)\x20((?:[^\W\d_][\w'-]*\x20){1,3})$").search(text, start, begin)
        if before and all(w[0].isupper() for w in before.group(2).split()):
            if before.start() >= last["address"]:
                add("address", before.start(), end)
            return
        m = HOUSE.match(text, end + 1) if text[end : end + 1] == " " else None
        if m:
            name = begin
            while name and text[name - 1].isalpha() and begin - name < 60:
                name -= 1
            if text[name : name + 1].isupper() and name >= last["address"]:
                add("address", name, m.end())

    def before(self, text, begin, end, add, last) -> None:
        if text[begin - 1 : begin].isalnum() or text[end : end + 1] != " " or begin < last["address"]:
            return
        at, words = end + 1, 0
        while words < 5 and (m := WORD.match(text, at)) and text[m.end() : m.end() + 1] in (" ", ","):
            at, words = m.end() + 1, words + 1
            at += text[at : at + 1] == " "
            if house := HOUSE.match(text, at):
                if text[end + 1].isupper() or words > 1:
                    add("address", begin, house.end())
                return


def find(docs: DataFrame) -> DataFrame:
    """Every row of `docs`, its text replaced by `spans`: array of (kind, start, end), by kind as listed, then start.

    Null is an empty text: no spans. Repeated rows are answered one by one.
    """

    def make():
        finder = Finder()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

        def fn(texts: list) -> list:
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in finder(t.decode("utf-8"))] if t else [] for t in texts]
            return [("spans", pa.array(spans, kind))]

        return fn

    return common.map_texts(docs, make, "spans array<struct<kind:string,start:long,end:long>>")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_anchor_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(common.read(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(of, BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
