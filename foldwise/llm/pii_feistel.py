"""Personal data: format-preserving pseudonyms by keyed Feistel permutations.

Card numbers (Luhn), phone numbers, IPv4 addresses, IBANs (mod 97), US social security numbers, e-mail addresses
and dates are found in the text and validated. What counts as their free part is permuted within its format by a
Feistel network keyed by a secret, so a pseudonym has the original's format and passes the same validation, and
equal values get equal pseudonyms in every document.
"""

from __future__ import annotations

import calendar
import datetime
import hashlib
import hmac
import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import text_of

ROUNDS = 8
#: Characters before the @ of an e-mail address that are permuted as one number; longer ones are blocks in a chain.
LOCAL_BLOCK = 64
DEFAULT_KEY = "pseudonyms: replace in production"
KINDS = ("email", "iban", "card", "ssn", "phone", "ip", "date")
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

#: In the order in which they are tried at a place.
PARTS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}(?![\w-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "date": r"(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})(?![\w/-])(?!\.[0-9])",
    "ip": r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w])(?!\.[0-9])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "card": r"(?<![\w.])[0-9](?:[ -]?[0-9]){12,18}(?![\w])(?!\.[0-9])",
    "phone": r"(?<![\w+(.])(?:\+[0-9]{8,15}|(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?|\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,4})(?![\w])(?!\.[0-9])",
}
PATTERN = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PARTS.items()))
PARTS = {k: re.compile(p) for k, p in PARTS.items()}
#: How cards are written: in one, or in these groups. Other groupings count where no such card starts within them.
CARD_SHAPE = re.compile(r"[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{3})?|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5}")
#: Lengths of the registered IBANs: the one of the country is tried first.
IBAN_LENGTHS = {
    c: n
    for n, cs in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT UA", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV",
        29: "BR EG PS QA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in cs.split()
}
#: Country codes of one and two digits; the others have three.
COUNTRY = re.compile(r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}")
#: Any of these has to be there for the pattern to match.
HINT = re.compile(r"[0-9@]")


class Feistel:
    """A keyed permutation of ``range(n)``: an unbalanced Feistel network on a grid, walked until inside.

    Each kind and format has its own tweak, hence its own permutation.
    """

    def __init__(self, key: str, tweak: str, n: int):
        self.n, self.a = n, math.isqrt(max(n - 1, 0)) + 1
        self.b = -(-n // self.a)
        self.keys = [hmac.new(key.encode(), f"{tweak}:{n}:{r}".encode(), hashlib.sha256).digest() for r in range(ROUNDS)]

    def _f(self, r: int, x: int, size: int) -> int:
        data = x.to_bytes((x.bit_length() + 7) // 8 or 1, "big")
        if size.bit_length() <= 64:
            return int.from_bytes(hashlib.blake2b(data, key=self.keys[r], digest_size=16).digest(), "big") % size
        # as many digests as have 64 bits more than the half, so that all of it is mixed
        digests = (hashlib.blake2b(data, key=self.keys[r], salt=i.to_bytes(16, "big")).digest() for i in range((size.bit_length() + 63) // 512 + 1))
        return int.from_bytes(b"".join(digests), "big") % size

    def _once(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for r in range(0, ROUNDS, 2):
            left = (left + self._f(r, right, self.a)) % self.a
            right = (right + self._f(r + 1, left, self.b)) % self.b
        return left * self.b + right

    def _back(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for r in range(ROUNDS - 2, -1, -2):
            right = (right - self._f(r + 1, left, self.b)) % self.b
            left = (left - self._f(r, right, self.a)) % self.a
        return left * self.b + right

    def _walk(self, x: int, step) -> int:
        x = step(x)
        while x >= self.n:
            x = step(x)
        return x

    def encrypt(self, x: int) -> int:
        return self._walk(x, self._once)

    def decrypt(self, x: int) -> int:
        return self._walk(x, self._back)


def luhn_digit(digits: str) -> str:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _refill(shape: str, chars: str, where) -> str:
    """``shape`` with the characters that ``where`` accepts replaced in turn."""
    it = iter(chars)
    return "".join(next(it) if where(c) else c for c in shape)


class Pseudonyms:
    """Validate a found value and give its pseudonym (or the value back, with ``reverse``)."""

    def __init__(self, key: str = DEFAULT_KEY, reverse: bool = False):
        self.key, self.reverse, self.cache = key, reverse, {}

    def permute(self, tweak: str, x: int, n: int) -> int:
        if n < 2:
            return x
        if (tweak, n) not in self.cache:
            if len(self.cache) > 4096:
                self.cache.clear()
            self.cache[tweak, n] = Feistel(self.key, tweak, n)
        f = self.cache[tweak, n]
        return f.decrypt(x) if self.reverse else f.encrypt(x)

    def digits(self, tweak: str, s: str) -> str:
        return str(self.permute(tweak, int(s), 10 ** len(s))).zfill(len(s)) if s else s

    def mixed(self, tweak: str, s: str) -> str:
        """Letters stay letters of their case, digits stay digits, other characters stay."""
        sizes = [26 if c.isascii() and c.isalpha() else 10 if c.isdigit() else 1 for c in s]
        x = n = 0
        n = 1
        for c, k in zip(s, sizes):
            x = x * k + (0 if k == 1 else ord(c.lower()) - 97 if k == 26 else int(c))
            n *= k
        x = self.permute(f"{tweak}:{'.'.join(map(str, sizes))}", x, n)
        out = []
        for c, k in zip(reversed(s), reversed(sizes)):
            x, d = divmod(x, k)
            out.append(c if k == 1 else str(d) if k == 10 else chr((65 if c.isupper() else 97) + d))
        return "".join(reversed(out))

    def email(self, v: str) -> str | None:
        local, _, domain = v.rpartition("@")
        if local.startswith(".") or local.endswith(".") or ".." in v:
            return None
        made, tweak = [], "email"
        for at in range(0, len(local), LOCAL_BLOCK):
            block = local[at : at + LOCAL_BLOCK]
            made.append(self.mixed(tweak, block))
            # each block's permutation hangs on the pseudonym so far, which is known in both directions
            tweak = f"email:{hashlib.sha256(f'{tweak}:{block if self.reverse else made[-1]}'.encode()).hexdigest()}"
        return "@".join(["".join(made), domain])

    def iban(self, v: str) -> str | None:
        s = v.replace(" ", "")
        if not 15 <= len(s) <= 34 or _mod97(s) != 1:
            return None
        body = self.mixed("iban" + s[:2], s[4:])
        check = str(98 - _mod97(s[:2] + "00" + body)).zfill(2)
        return _refill(v, s[:2] + check + body, lambda c: c != " ")

    def card(self, v: str) -> str | None:
        s = re.sub(r"[ -]", "", v)
        if luhn_digit(s[:-1]) != s[-1] or len(set(s)) == 1:
            return None
        body = s[0] + self.digits(f"card{s[0]}", s[1:-1])
        return _refill(v, body + luhn_digit(body), str.isdigit)

    def ssn(self, v: str) -> str | None:
        a, b, c = (int(x) for x in v.split("-"))
        valid = [x for x in range(1, 900) if x != 666]
        if a not in valid or not b or not c:
            return None
        x = self.permute("ssn", (valid.index(a) * 99 + b - 1) * 9999 + c - 1, len(valid) * 99 * 9999)
        x, c = divmod(x, 9999)
        a, b = divmod(x, 99)
        return f"{valid[a]:03d}-{b + 1:02d}-{c + 1:04d}"

    def phone(self, v: str) -> str | None:
        s = re.sub(r"\D", "", v)
        if not 8 <= len(s) <= 15:
            return None
        country = len(re.match(r"\+(\d*)", v)[1]) if v.startswith("+") else 0
        if country > 3:  # written together with what follows
            country = COUNTRY.match(s).end()
        rest = s[country:]
        valid = lambda r: r[0] not in "01" and r[3] not in "01"
        if country == 1 and len(rest) == 10 and valid(rest):  # area and exchange start with 2 to 9
            x = self.permute("nanp", ((int(rest[:3]) - 200) * 800 + int(rest[3:6]) - 200) * 10_000 + int(rest[6:]), 800 * 800 * 10_000)
            x, line = divmod(x, 10_000)
            area, exchange = divmod(x, 800)
            new = f"{area + 200:03d}{exchange + 200:03d}{line:04d}"
        else:
            new = self.digits(f"phone{s[:country]}", rest)
            while country == 1 and len(rest) == 10 and valid(new):  # stay among the numbers that are not dialled
                new = self.digits(f"phone{s[:country]}", new)
        return _refill(v, s[:country] + new, str.isdigit)

    def ip(self, v: str) -> str | None:
        parts = v.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        # each octet keeps its number of digits, so the address keeps its length
        lows, sizes = zip(*[((0, 10), (10, 90), (100, 156))[len(p) - 1] for p in parts])
        x, n = 0, 1
        for p, lo, k in zip(parts, lows, sizes):
            x, n = x * k + int(p) - lo, n * k
        x = self.permute("ip" + ".".join(str(len(p)) for p in parts), x, n)
        out = []
        for lo, k in zip(reversed(lows), reversed(sizes)):
            x, d = divmod(x, k)
            out.append(str(lo + d))
        return ".".join(reversed(out))

    def date(self, v: str) -> str | None:
        """Dates are permuted within their year, in all notations alike; day and month keep their order and width.

        A date whose place in the permutation doesn't fit the notation (one digit for the month, say) goes on to the next
        that does. Years, and so ages, stay what they are.
        """
        try:
            if "-" in v:
                y, m, d = (int(x) for x in v.split("-"))
                day = datetime.date(y, m, d)
            else:
                sep = "." if "." in v else "/"
                if v.count(sep) != 2:
                    return None
                p, q, y = v.split(sep)
                d, m = (int(p), int(q)) if int(q) <= 12 else (int(q), int(p))
                day = datetime.date(int(y), m, d)
        except ValueError:
            return None
        if not FIRST_DAY <= day.toordinal() <= LAST_DAY:
            return None
        if "-" in v:
            new = self._in_year(day, lambda x: True)
            return f"{new:%Y-%m-%d}"
        day_first = int(q) <= 12
        text = lambda x: (x.day, x.month) if day_first else (x.month, x.day)

        def fits(x: datetime.date) -> bool:
            a, b = text(x)
            padded = len(p) == len(q) == 2
            return (padded or all((z < 10) == (len(s) == 1 or s[0] == "0") for s, z in ((p, a), (q, b)))) and (day_first or b > 12)

        new = self._in_year(day, fits)
        a, b = text(new)
        return f"{str(a).zfill(len(p))}{sep}{str(b).zfill(len(q))}{sep}{new.year:04d}"

    def _in_year(self, day: datetime.date, fits) -> datetime.date:
        first = datetime.date(day.year, 1, 1)
        while True:
            day = first + datetime.timedelta(self.permute(f"date{first.year}", (day - first).days, 365 + calendar.isleap(first.year)))
            if fits(day):
                return day

    def replace(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and what was replaced: kind, start and end in code points (both texts)."""
        if not HINT.search(text):
            return text, []
        out, spans, at, look = [], [], 0, 0
        while m := PATTERN.search(text, look):
            found = self._read(text, m)
            if found is None:
                look = self._after(text, m)
                continue
            kind, end, new = found
            out += [text[at : m.start()], new]
            spans.append((kind, m.start(), end))
            at = look = end
        return "".join(out) + text[at:], spans

    def restore(self, text: str, spans: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with the values of known spans (``kind:start:end``, joined by commas) replaced, whatever is beside them."""
        out, found, at = [], [], 0
        for kind, start, end in (x.split(":") for x in spans.split(",") if x):
            start, end = int(start), int(end)
            new = getattr(self, kind)(text[start:end])
            out += [text[at:start], text[start:end] if new is None else new]
            found.append((kind, start, end))
            at = end
        return "".join(out) + text[at:], found

    def _read(self, text: str, m: re.Match) -> tuple[str, int, str] | None:
        """The first valid reading at a match's start: kind, end and pseudonym.

        A match may have taken in what follows the value, so shorter ones and the other kinds are tried as well. A
        phone number or an oddly grouped card is not read across the start of a card in one of the usual shapes.
        """
        start = m.start()
        for kind, pattern in PARTS.items():
            if not (h := pattern.match(text, start)):
                continue
            for end in self._ends(kind, h):
                value = text[start:end]
                new = getattr(self, kind)(value)
                if new is None:
                    continue
                weak = kind == "phone" or (kind == "card" and not self._usual(value))
                if not (weak and any(self._card_at(text, i) for i in range(start + 1 + (text[start] == "+"), end))):
                    return kind, end, new
        return None

    @staticmethod
    def _ends(kind: str, h: re.Match) -> list[int]:
        """Where a match may end: cards and IBANs at any border of their groups too, likeliest first."""
        v, start = h[0], h.start()
        if kind not in ("card", "iban"):
            return [h.end()]
        least = 13 if kind == "card" else 15
        cuts = [i for i in range(least, len(v) + 1) if (i == len(v) or v[i] in " -") and sum(c not in " -" for c in v[:i]) >= least]
        if kind == "card":
            likely = lambda i: CARD_SHAPE.fullmatch(v[:i]) is not None
        else:
            likely = lambda i: len(v[:i].replace(" ", "")) == IBAN_LENGTHS.get(v[:2])
        return [start + i for i in sorted(cuts, key=lambda i: (not likely(i), -i))]

    def _card_at(self, text: str, start: int) -> bool:
        """Whether a valid card in one of the usual shapes starts here."""
        h = PARTS["card"].match(text, start)
        return h is not None and any(self._usual(text[start:e]) and self.card(text[start:e]) for e in self._ends("card", h))

    @staticmethod
    def _usual(card: str) -> bool:
        """Whether a card has a usual shape and the first digit of the large issuers; years and counts before a card have not."""
        return card[0] in "3456" and CARD_SHAPE.fullmatch(card) is not None

    @staticmethod
    def _after(text: str, m: re.Match) -> int:
        """Where to look on after an invalid value: at the end of its first run of word characters."""
        run = re.compile(r"[+(]*\w+").match(text, m.start())
        return max(m.start() + 1, min(run.end() if run else m.end(), m.end()))


def pseudonymise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = DEFAULT_KEY, reverse: bool = False) -> DataFrame:
    """``doc_id, text, n_<kind>..., spans``: one row per input row, its text with pseudonyms.

    ``spans`` lists ``kind:start:end`` of what was replaced, in code points; a pseudonym is as long as its value,
    so they hold for both texts. ``reverse`` with the same key gives the values back: by their ``spans`` if the table
    has them, which is always exact; otherwise values are found anew, and one beside another number can, by the
    chance of a checksum, be read with it. A card in fours before three more digits (4-4-4-4-3) is read as one of 19
    digits where all of them pass Luhn, so nothing of such a card stays. E-mail addresses keep their domain, dates their
    year. Numbers that fail their validation stay as they are. Null text counts as empty; repeated rows are each replaced; null ids stay null;
    an empty table gives an empty result, and other columns are ignored.
    """

    def run(batches):
        p = Pseudonyms(key, reverse)
        for b in batches:
            done = [p.replace(t) if z is None else p.restore(t, z) for t, z in zip(b["text"], b["known"])]
            texts, found = zip(*done) if done else ((), ())
            out = pd.DataFrame({"doc_id": b["doc_id"], "text": texts})
            for kind in KINDS:
                out[f"n_{kind}"] = [sum(s[0] == kind for s in spans) for spans in found]
            out["spans"] = [",".join(f"{k}:{a}:{z}" for k, a, z in spans) for spans in found]
            yield out

    schema = "doc_id string, text string, " + ", ".join(f"n_{k} long" for k in KINDS) + ", spans string"
    known = F.col("spans") if reverse and "spans" in docs.columns else F.lit(None)
    # ids go through pandas as strings: beside a null, whole numbers would be rounded to floats
    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), text_of(text_col).alias("text"), known.cast("string").alias("known"))
    return rows.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast("long"))
