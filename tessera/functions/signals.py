"""What messages signal: payments, rejections, acceptances, re-pastes; and the wording of updates."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessera.functions.text import ANY_CASE, blank, normalized, once, strip, tokens

#: Words and amounts of settlements, at most ten spaces or colons apart.
PAY_WORD = r"(?:paid|pay|parts?|tip|cash|cc|zelle|venmo|card|charged|collected|total|closed?)"
AMOUNT = r"(?:\$\s?\d+(?:[.,]\d+)?|\d+(?:[.,]\d+)?\s?\$|\d{2,}(?:[.,]\d+)?)"
SETTLEMENT = rf"{ANY_CASE}\b{PAY_WORD}\b[\s:]{{0,10}}{AMOUNT}\b|\b{AMOUNT}\b[\s:]{{0,10}}\b{PAY_WORD}\b"
#: Phrases by which operators and technicians decline or accept.
REJECT = [
    "have it", "i have it", "we have it", "pass", "passing", "pass on this", "cant take", "can't take", "cannot take", "cant take it",
    "can't take it", "cant take this", "can't take this", "cant do", "can't do", "cannot do", "cant do it", "can't do it", "no can do",
    "cant help", "can't help", "cannot help", "sorry cant help", "sorry can't help",
]
REJECT_WORDS = [
    r"\bno\s+one\b", r"\bnobody\s+available\b", r"\bno\s+techs?\s+available\b", r"\bnot\s+available\b", r"\bsorry\b.{0,40}\bno\b",
]
TECH_ACCEPT = [
    "ok", "okay", "k", "kk", "yes", "yep", "yeah", "ya", "yup", "sure", "got it", "gotit", "on it", "onit", "im on it", "i got it",
    "copy", "copy that", "will do", "10 4",
]
TECH_REJECT = [
    "pass", "passing", "no", "nope", "nah", "cant", "can't", "cannot", "cant take", "can't take", "cannot take", "cant take it",
    "cant do it", "not me", "skip",
]
#: Notes that make a re-paste no rejection.
QUESTION = r"\?|\bwrong\s+(?:number|address|phone|info)\b|\bcorrect\s+(?:number|address|phone)\b|\b(?:check|confirm|verify)\b"
APPOINTMENT = r"\bappt\b|\bappointment\b|\btomorrow\b|\btmrw\b|\btomm?orow\b|\b\d{1,2}(?::\d{2})?\s*(?:am|pm)\b"
#: Wording of reasons in updates to companies, and the kinds that are relayed.
REASONS = {
    "refused": "customer refused the price", "dns": "customer did not need service", "solved": "customer solved it themselves",
    "no_service": "no service needed", "priceshopping": "customer is price-shopping", "will_cb": "customer will call back",
    "callback": "customer wants a callback",
}
#: The line that holds a job's address, the zip code beside a "pass", and the limits of re-pastes and rejections.
ADDRESS_LINE = r"(?imd)^\s*addr(?:ess)?\s*:\s*(.+)$"
ZIP_ALONE = r"\b\d{5}\b"
LEAST_JOB, MOST_NOTE, LEAST_RATIO, MOST_ZIP_WORDS, MOST_WORDS = 25, 200, 0.75, 4, 12
RELAYED = ["in_progress", "appt_set", "needs_follow_up", "canceled"]
#: What a technician's message says and the state that it leads to.
INTENTS = {"in_progress": "in_progress", "appt_set": "appt_set", "needs_follow_up": "needs_follow_up", "canceled": "canceled"}


def _plain(phrases: list[str]) -> list[str]:
    """Phrases as `normalized` writes them: apostrophes become spaces."""
    return sorted({" ".join(p.replace("'", " ").split()) for p in phrases})


def payment_tokens(x: Column) -> Column:
    """All settlements in a message, lower case; null if there is none."""
    found = F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(SETTLEMENT), 0)
    return once(found, lambda f: F.when(F.size(f) > 0, F.transform(f, lambda m: F.lower(strip(m)))))


def address_line(x: Column) -> Column:
    """What stands behind 'Addr:' at the start of a line."""
    return F.nullif(F.regexp_extract(F.coalesce(x, F.lit("")), ADDRESS_LINE, 1), F.lit(""))


def is_reject_phrase(x: Column) -> Column:
    t = normalized(x)
    n = F.size(tokens(t))
    starts = F.lit(False)
    for p in _plain(REJECT):
        starts = starts | (t == p) | t.startswith(p + " ")
    words = F.lit(False)
    for p in REJECT_WORDS:
        words = words | t.rlike(f"(?U){p}")
    zip_pass = (n <= MOST_ZIP_WORDS) & t.rlike(r"\b(?:pass|passing)\b") & t.rlike(ZIP_ALONE)
    return (t != "") & (t.isin(_plain(REJECT)) | zip_pass | ((n <= MOST_WORDS) & (starts | words)))


def is_tech_accept(x: Column) -> Column:
    return normalized(x).isin(_plain(TECH_ACCEPT))


def is_tech_reject(x: Column) -> Column:
    return normalized(x).isin(_plain(TECH_REJECT))


@F.pandas_udf(DoubleType())
def similarity(job: pd.Series, reply: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two texts, job first; Spark has no function that equals it."""
    return pd.Series([SequenceMatcher(None, a or "", b or "").ratio() for a, b in zip(job, reply, strict=True)])


def vetoes_rejection(x: Column) -> Column:
    """Whether a note reads as a question, an appointment or a payment."""
    t = F.coalesce(x, F.lit(""))
    return t.rlike(ANY_CASE + QUESTION) | t.rlike(ANY_CASE + APPOINTMENT) | t.rlike(SETTLEMENT)


def is_repaste_with_note(reply: Column, job: Column) -> Column:
    """A reply that repeats the job (or comes close to it, at LEAST_RATIO) with a short note, which isn't a veto."""
    r, j = normalized(reply), normalized(job)
    extra = F.length(r) - F.length(j)
    eligible = (F.length(j) >= LEAST_JOB) & (r != "") & (r != j) & ~vetoes_rejection(reply)
    held = F.contains(r, j)
    # texts whose lengths differ too much can't reach the ratio, so they never meet the Python function
    near = eligible & ~held & (extra >= 0) & (2 * F.length(j) >= LEAST_RATIO * (F.length(j) + F.length(r)))
    close = similarity(F.when(near, j), F.when(near, r)) >= LEAST_RATIO
    return F.coalesce(eligible & ((held & (extra > 0) & (extra <= MOST_NOTE)) | (near & close)), F.lit(False))


def is_reject_signal(reply: Column, job: Column | None = None) -> Column:
    out = is_reject_phrase(reply)
    if job is not None:
        out = out | is_repaste_with_note(reply, job)
    return ~blank(reply) & out


def reason_phrase(reason: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, reason), reason, F.lit(""))


#: Wording of updates to companies; times, reasons and notes follow their words.
UPDATE = {
    "in_progress": "Update: technician is on the way.", "appt_set": "Update: appointment set", "appt_time": " for ", "needs_follow_up": "Update: needs follow-up",
    "follow_up_time": " Will follow up around ", "canceled": "Update: job canceled", "other": "Update: ", "note": " Note: ",
}


def update_line(kind: Column, appt: Column, follow_up: Column, reason: Column, notes: Column) -> Column:
    given = lambda c: F.nullif(c, F.lit(""))
    why = reason_phrase(given(reason))
    some = lambda *parts: F.coalesce(F.concat(*parts), F.lit(""))  # noqa: E731  "" if any part is null
    line = (
        F.when(kind == "in_progress", UPDATE["in_progress"])
        .when(kind == "appt_set", F.concat(F.lit(UPDATE["appt_set"]), some(F.lit(UPDATE["appt_time"]), given(appt)), F.lit(".")))
        .when(
            kind == "needs_follow_up",
            F.concat(
                F.lit(UPDATE["needs_follow_up"]), F.when(given(reason).isNotNull(), F.concat(F.lit(" ("), why, F.lit(")"))).otherwise(""), F.lit("."),
                some(F.lit(UPDATE["follow_up_time"]), given(follow_up), F.lit(".")),
            ),
        )
        .when(kind == "canceled", F.concat(F.lit(UPDATE["canceled"]), F.when(given(reason).isNotNull(), F.concat(F.lit(" — "), why)).otherwise(""), F.lit(".")))
        .otherwise(F.concat(F.lit(UPDATE["other"]), kind, F.lit(".")))
    )
    return F.concat(line, some(F.lit(UPDATE["note"]), given(notes)))


def relay_text(body: Column, line: Column) -> Column:
    own = strip(F.coalesce(body, F.lit("")))
    return F.when(own == "", line).otherwise(F.concat(own, F.lit("\n\n"), line))


def status_of_intent(intent: Column) -> Column:
    """The state that a technician's intent leads to; null for any other."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in INTENTS.items() for x in kv]), intent)
