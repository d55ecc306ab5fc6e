"""Redaction of personal values, search for leaks, redacted corpora.

Redaction is a chain of passes in an order which matters (labelled identifiers before bare digit runs, names last).  A text goes
through all of them in one call of a function over Arrow batches: as one projection for each pass, most of the time went into what is
no search (rows copied, texts decoded).  Salt and date shift are arguments; nothing is drawn at random on an executor.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from khata.functions import fixed_values as V
from khata.functions.plain import SPACES, compiled
from khata.functions.text import has, hits, swap

# the passes travel with the job: executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Length of the longest run of digits in a text, beside it.
RUN = "_run"


def longest_run(text: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("[0-9]+"), 0), F.length)), F.lit(0))


@dataclass(frozen=True)
class Pass:
    """One rewriting step: what it counts as, its pattern, and a constant or computed replacement.

    ``digits``, ``holds`` and ``needs`` are necessary for a hit and cheap to see: the longest run of digits in the text, words of which the
    text must contain one (in lower case for a pattern which ignores case), and a part of the pattern which is found without look-around.
    ``counts`` says which hits count; all, if there is none.  After a pass which ``lengthens`` no run of digits the length of the
    longest one isn't looked up again.
    """

    kind: str
    pattern: str
    make: str | Callable[[re.Match[str]], str]
    flags: str = ""
    digits: int = 0
    holds: tuple[str, ...] = ()
    needs: str = ""
    counts: Callable[[re.Match[str]], bool] | None = None
    lengthens: bool = True

    def found(self, text: Column) -> Column:
        """Whether there is a hit, as a column; the pattern is searched only in texts which can have one."""
        tests = [F.col(RUN) >= self.digits] if self.digits else []
        if self.holds:
            shown = F.lower(text) if "i" in self.flags else text
            tests.append(reduce(lambda a, b: a | b, [F.contains(shown, F.lit(w)) for w in self.holds]))
        if self.needs:
            tests.append(has(text, self.needs, self.flags))
        return reduce(lambda a, b: a & b, [*tests, has(text, self.pattern, self.flags)])


DIGIT, LETTER_OR_DIGIT, GAPS = re.compile("[0-9]"), re.compile("[A-Za-z0-9]"), re.compile(f"[{SPACES}]+")
NAME_WORD = re.compile(r"[A-Za-z][A-Za-z.'-]*")
DIGITS_TO_LETTERS = str.maketrans("0123456789", "abcdefabcd")


def pseudonym(kind: str, value: str, salt: str, width: int) -> str:
    """KIND_hhhh: the same value has the same name under one salt.

    Beyond four characters digits become letters, or later passes would take a run of them for a number.
    """
    name = hashlib.sha256((salt + kind + value.strip(" ").lower()).encode()).hexdigest()[:width]
    return f"{kind}_{name if width <= 4 else name.translate(DIGITS_TO_LETTERS)}"


def is_name(text: str, stop_words: frozenset[str], ends_only: bool = False) -> bool:
    """At most six words of letters, not all of them stop words, one of the others capitalised.

    Full stops and commas in a word don't count when it is looked up; with ``ends_only`` only those at its ends.
    """
    words = [w for w in GAPS.sub(" ", text.strip(" ")).split(" ") if w]
    if not 1 <= len(words) <= 6 or not all(NAME_WORD.fullmatch(w) for w in words):
        return False
    bare = (lambda w: w.strip(".,")) if ends_only else (lambda w: w.replace(".", "").replace(",", ""))
    return any("A" <= w[0] <= "Z" and bare(w.lower()) not in stop_words for w in words)


def name_test(rules: str, stop_words: tuple[str, ...] = ()) -> Callable[[str], bool]:
    """The name test of a rule set, with words of the caller."""
    session = rules == "session"
    known = frozenset((*V.NOT_NAMES, *(V.NOT_NAMES_SESSION if session else ()), *stop_words))
    return lambda text: is_name(text, known, ends_only=not session)


#: The calendar repeats after 400 years.
CYCLE, CYCLE_DAYS = 400, 146_097


def _two(number: int) -> str:
    return str(number)[:2].rjust(2, "0")


def _shifted(day: str, month: int, year: str, shift_days: int) -> tuple[int, int, int] | None:
    """(year, month, day) of the real date moved by the shift; None for a date that does not exist."""
    d, y = int(day), int(year)
    if y < 100:
        y += 2000
    if d < 1 or not 1 <= month <= 12:
        return None
    at = date(2000 + y % CYCLE, month, 1) + timedelta(d - 1)
    if at.month != month:
        return None
    cycles, rest = divmod(shift_days, CYCLE_DAYS)
    moved = at + timedelta(rest)
    return moved.year + y - (2000 + y % CYCLE) + cycles * CYCLE, moved.month, moved.day


def _year_like(year: int, sample: str) -> str:
    if len(sample) != 2:
        return str(year)
    return _two(year % 100 if year >= 0 else -(-year % 100))


def _date_passes(shift: int) -> list[Pass]:
    months = {name: i for i, name in enumerate(V.MONTHS, 1)}
    names = [m.capitalize() for m in V.MONTHS]

    def numeric(m: re.Match[str]) -> str:
        hit, d, sep, mon, y = m.group(0, 1, 2, 3, 4)
        moved = _shifted(d, int(mon), y, shift)
        return hit if moved is None else f"{_two(moved[2])}{sep}{_two(moved[1])}{sep}{_year_like(moved[0], y)}"

    def named(m: re.Match[str]) -> str:
        hit, d, s1, mon, tail, s2, y = m.group(0, 1, 2, 3, 4, 5, 6)
        moved = _shifted(d, months.get(mon.lower(), 0), y, shift)
        if moved is None:
            return hit
        name = names[moved[1] - 1]
        return f"{_two(moved[2])}{s1}{name.upper() if mon == mon.upper() else name}{tail}{s2}{_year_like(moved[0], y)}"

    def lead(m: re.Match[str]) -> str:
        hit, mon, d, y = m.group(0, 1, 2, 3)
        moved = _shifted(d, months.get(mon.lower(), 0), y, shift)
        return hit if moved is None else f"{names[moved[1] - 1]} {_two(moved[2])}, {moved[0]}"

    return [
        Pass("date", V.DATE_NUMERIC, numeric, digits=2),
        Pass("date", V.DATE_NAMED, named, digits=2),
        Pass("date", V.DATE_LEADING, lead, digits=4, needs=V.DATE_LEADING_NEEDS),
    ]


def _blank_date_passes() -> list[Pass]:
    return [
        Pass("date", V.DATE_NUMERIC_BLANK, V.DATE_NUMERIC_MASK, digits=2),
        Pass("date", V.DATE_NAMED_BLANK, V.DATE_NAMED_MASK, digits=2),
    ]


def passes(salt: str, shift_days: int, rules: str = "session", width: int = 24,
           blank_dates: bool = False, stop_words: tuple[str, ...] = ()) -> list[Pass]:
    """The ordered passes of a rule set: ``session`` (single reports) or ``offline`` (bulk files)."""
    session = rules == "session"
    if rules not in ("session", "offline"):
        raise ValueError(f"unknown rule set: {rules}")
    psp = V.PSP_SESSION if session else V.PSP_OFFLINE
    domains = V.TOP_DOMAINS_SESSION if session else V.TOP_DOMAINS_OFFLINE

    # what the functions use is bound here, so that no module goes with them
    named_so, phone_handle, aadhaar = name_test(rules, stop_words), compiled(V.PHONE_HANDLE, ""), V.AADHAAR_MASK

    def fill(m: re.Match[str]) -> str:
        return "9" * len(m[0])

    def nines(text: str) -> str:
        return DIGIT.sub("9", text)

    def tagged(kind: str, value: str) -> str:
        return pseudonym(kind, value, salt, width)

    def handle(m: re.Match[str]) -> str:
        who = "9999999999" if phone_handle.search(m[1]) else tagged("VPA", m[1])
        return f"{who}@{m[2]}"

    def named(m: re.Match[str]) -> str:
        who = m[2].rstrip(" ")
        return m[1] + tagged("PERSON", who) if named_so(who) else m[0]

    def account(m: re.Match[str]) -> str:
        word, no, mask, digits = m[1], m[2] or "", m[3], "9" * len(m[4])
        if session:
            return GAPS.sub(" ", f"{word}{no} {mask}{digits}")
        return f"{word} {no + ' ' if no else ''}{mask}{digits}".replace("  ", " ")

    def mask_and_nines(m: re.Match[str]) -> str:
        return m[1] + "9" * len(m[2])

    result = [
        Pass("email", V.EMAIL, V.EMAIL_MASK, holds=("@",), needs=V.EMAIL_NEEDS),
        Pass("pan", V.PAN, V.PAN_MASK, digits=4, needs=V.PAN_NEEDS),
    ]
    if session:
        result += [
            Pass("aadhaar", V.AADHAAR_SPACED, V.AADHAAR_MASK, digits=4, needs=V.AADHAAR_SPACED_NEEDS),
            Pass("aadhaar", V.AADHAAR_LABELLED, lambda m: m[1] + m[2] + aadhaar, "i", digits=8, holds=("aadhaar", "uidai")),
        ]
    else:
        result += [Pass("aadhaar", V.AADHAAR_OFFLINE, V.AADHAAR_MASK, digits=4)]
    result += [
        Pass("ifsc", V.IFSC, V.IFSC_MASK, holds=("0",)),
        Pass("card_or_long_id", V.CARD, fill, digits=13, lengthens=False),
        Pass("vpa", V.VPA.replace("PSP", psp), handle, "i", holds=("@",)),
    ]
    if session:
        result += [
            Pass("otp", V.OTP_AFTER, lambda m: m[1] + m[2] + "9" * len(m[3]), "i", digits=4,
                 holds=("otp", "o.t.p", "one", "verification code", "security code", "passcode", "pin")),
            Pass("otp", V.OTP_BEFORE, lambda m: "9" * len(m[1]) + m[2], "i", digits=4, holds=("your",)),
            Pass("helpline", V.HELPLINE, V.HELPLINE_MASK, digits=4, holds=("1800",)),
            Pass("helpline", V.HELPLINE_18, V.HELPLINE_MASK, digits=6, holds=("18",)),
            Pass("phone", V.PHONE_91, V.PHONE_91_MASK, digits=10, holds=("91",)),
            Pass("phone", V.PHONE_LANDLINE, V.PHONE_LANDLINE_MASK, digits=6, holds=("0",), lengthens=False),
            Pass("phone", V.PHONE, V.PHONE_MASK, digits=10, lengthens=False),
            Pass("shortcode", V.SHORTCODE, lambda m: f"{m[1]} {'9' * len(m[2])}", "i", digits=5, lengthens=False),
        ]
    else:
        result += [
            Pass("phone", V.PHONE_OFFLINE, V.PHONE_MASK, digits=10),
            Pass("helpline", V.HELPLINE_OFFLINE, V.HELPLINE_MASK, digits=4, holds=("1800",)),
        ]
    result += [
        Pass("account", V.ACCOUNT_SESSION if session else V.ACCOUNT_OFFLINE, account, "i", digits=3, lengthens=False),
        Pass("masked_tail", V.MASKED_TAIL, mask_and_nines, "i", digits=4, holds=("x", "*"), lengthens=False),
        Pass("reference", V.REFERENCE_ID, lambda m: f"{m[1]} {LETTER_OR_DIGIT.sub('9', m[2])}", "i",
             holds=("ref", "rrn", "utr", "txn", "transaction no", "umn", "sr", "awb", "order id", "application")),
        Pass("application_id", V.APPLICATION_ID, V.APPLICATION_ID_MASK, holds=("IHL", "MHL", "SR")),
    ]
    if session:
        result += [
            Pass("long_id", V.LONG_ID, fill, digits=7, lengthens=False),
            Pass("masked_tail", V.LONG_MASKED_TAIL, mask_and_nines, digits=2, needs=V.LONG_MASKED_TAIL_NEEDS, lengthens=False),
        ]
    result += [
        Pass("url", V.URL, V.URL_MASK, holds=("http",)),
        Pass("short_url", V.SHORT_URL.replace("DOMAINS", domains), V.SHORT_URL_MASK, "i", holds=tuple(f".{d}" for d in domains.split("|"))),
        Pass("amount", V.AMOUNT_AFTER, lambda m: m[1] + nines(m[2]), "i", holds=("inr", "rs", "₹"), lengthens=False),
        Pass("amount", V.AMOUNT_BEFORE, lambda m: nines(m[1]) + m[2], "i", holds=("inr", "rs", "₹"), needs=V.AMOUNT_BEFORE_NEEDS, lengthens=False),
    ]
    result += _blank_date_passes() if blank_dates else _date_passes(shift_days)
    result += [Pass("time", V.TIME, V.TIME_MASK, digits=2, holds=(":",))]
    if session:
        result += [Pass("name_titled", V.NAME_TITLED, lambda m: m[1] + tagged("PERSON", m[2]),
                        holds=("Mr", "Ms", "Dr", "Shri", "Smt", "Sri", "Kum"))]
    result += [
        Pass("name", V.NAME_TO, named, "i", holds=("to",)),
        Pass("name", V.NAME_FROM, named, holds=("from",)),
        Pass("name", V.NAME_DEAR, named, holds=("Dear",)),
        Pass("name", V.NAME_RECEIVED, named, "i", holds=("received by",)),
        Pass("name", V.NAME_CREDITED, named, "i", holds=("credited by",))
        if session else Pass("name", V.NAME_PAYMENT, named, holds=("payment of ",)),
        Pass("name_initials", V.NAME_INITIALS, lambda m: tagged("PERSON", m[0])),
        Pass("name_caps", V.NAME_CAPS, lambda m: tagged("PERSON", m[0]) if named_so(m[0]) else m[0]),
    ]
    if session:
        result += [Pass("name_salutation", V.NAME_SALUTATION, lambda m: tagged("PERSON", m[1]) + "," if named_so(m[1]) else m[0], "m",
                        holds=(",",), counts=lambda m: named_so(m[1]))]
    return result


def rewriter(steps: list[Pass]) -> Callable[[str], tuple[str, dict[str, int]]]:
    """A function which takes a text through all passes: the new text, and the hits by category."""
    kinds = list(dict.fromkeys(s.kind for s in steps))
    runs = re.compile("[0-9]+")
    chain = [(kinds.index(s.kind), compiled(s.pattern, s.flags), s.make, s.digits, s.holds, "i" in s.flags,
              compiled(s.needs, s.flags).search if s.needs else None, s.counts, s.lengthens) for s in steps]

    def rewritten(text: str) -> tuple[str, dict[str, int]]:
        found: dict[int, int] = {}
        low, run = None, -1
        for kind, pattern, make, digits, holds, fold, needs, counts, lengthens in chain:
            if digits:
                if run < 0:
                    run = max(map(len, runs.findall(text)), default=0)
                if run < digits:
                    continue
            if holds:
                if fold and low is None:
                    low = text.lower()
                shown = low if fold else text
                for word in holds:
                    if word in shown:
                        break
                else:
                    continue
            if needs is not None and needs(text) is None:
                continue
            new, n = pattern.subn(make, text)
            if n:
                if counts is not None:
                    n = sum(map(counts, pattern.finditer(text)))
                if n:
                    found[kind] = found.get(kind, 0) + n
                text, low = new, None
                if lengthens:
                    run = -1
        return text, {kinds[k]: found[k] for k in sorted(found)}

    return rewritten


def _rewritten(steps: list[Pass], counts: bool) -> Callable[..., Column]:
    """The passes as a function of a binary column: text, and with ``counts`` the map of hits.  A text without a hit keeps its bytes."""
    run = rewriter(steps)

    def batch(column: pa.Array) -> pa.Array:
        texts, ends, kinds, times = [], [0], [], []
        for raw in column.to_pylist():
            text = raw.decode("utf-8", "replace")
            new, found = run(text)
            texts.append(raw if new == text else new.encode())
            kinds.extend(found)
            times.extend(found.values())
            ends.append(len(kinds))
        parts = [pa.array(texts, pa.binary())]
        if counts:
            parts.append(pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(kinds, pa.string()), pa.array(times, pa.int32())))
        return pa.StructArray.from_arrays(parts, names=["text", "replaced"][: len(parts)])

    return F.arrow_udf(batch, "struct<text: binary" + (", replaced: map<string, int>>" if counts else ">"))


def redact(df: DataFrame, column: str, salt: str, shift_days: int, counts: bool = True, **options) -> DataFrame:
    """Rewrites a text column and, with ``counts``, adds ``replaced``: a map of category to hits.

    Options are those of ``passes``.  The result leaves through a generator of one row, so that a later filter on it is not pushed
    through the passes.
    """
    run = _rewritten(passes(salt, shift_days, **options), counts)
    work = df.withColumn("_done", run(F.coalesce(F.col(column), F.lit("")).cast("binary")))
    result = [F.col("_done.text").cast("string").alias(column), *([F.col("_done.replaced").alias("replaced")] if counts else [])]
    others = [c for c in df.columns if c != column]
    made = work.select(*others, F.inline(F.array(F.struct(*result))))
    return made.select(*df.columns, *(["replaced"] if counts else []))


def leaks_in(text: Column) -> Column:
    """Labels of personal patterns which occur in the text outside the redactor's placeholders."""

    def clean(hit: Column) -> Column:
        core = F.trim(hit)
        return has(core, V.PLACEHOLDER, "") | has(core, V.PLACEHOLDER_FILL, "")

    needs = {"an email address": V.EMAIL_NEEDS, "a PAN": V.PAN_NEEDS}

    def leaks(label: str, pattern: str, flags: str) -> Column:
        seen = F.exists(hits(text, pattern, flags), lambda h: ~clean(h))
        return has(text, needs[label], "") & seen if label in needs else seen

    found = [F.when(leaks(*leak), F.lit(leak[0])) for leak in V.LEAKS]
    return F.array_compact(F.array(*found))


def find_leaks(df: DataFrame, column: str) -> DataFrame:
    """Rows with at least one leak, with their labels in ``warnings``."""
    found = F.struct(leaks_in(F.col(column)).alias("warnings"))
    return df.select(*df.columns, F.inline(F.array(found))).where(F.size("warnings") > 0)


def leak_counts(df: DataFrame, column: str) -> DataFrame:
    """Number of rows per kind of leak."""
    found = F.struct(leaks_in(F.col(column)).alias("warnings"))
    return (
        df.select(F.inline(F.array(found))).select(F.explode("warnings").alias("leak"))
        .groupBy("leak").agg(F.count("*").alias("rows"))
    )


def require_redacted(df: DataFrame, column: str, force: bool = False) -> DataFrame:
    """Passes the table on, or refuses it when any row still leaks.  All rows are looked at."""
    if not force:
        leaks = leak_counts(df, column).collect()  # one row per kind of leak, seven at most
        if leaks:
            listed = ", ".join(f"{r['leak']} in {r['rows']} rows" for r in leaks)
            raise ValueError(f"the table is not redacted: {listed}")
    return df


def redact_corpus(messages: DataFrame, salt: str, shift_days: int, **options) -> DataFrame:
    """Redacted messages with normalised sender; empty bodies are left out, dates stay."""
    options = {"rules": "offline"} | options
    rows = messages.withColumn("body", F.trim("body")).where(F.coalesce("body", F.lit("")) != "")
    rows = rows.withColumn("address", swap(F.upper(F.coalesce("address", F.lit(""))), V.OPERATOR_PREFIX, "", ""))
    return redact(rows, "body", salt, shift_days, **options)
