"""Column functions against golden values."""

from datetime import UTC, date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from tessera.functions import contact, extraction, signals, text, values


def over(spark, rows, make, schema="x string"):
    rows = [r if isinstance(r, tuple) else (r,) for r in rows]
    names = [s.split()[0] for s in schema.split(", ")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    got = df.select("i", make(*[F.col(n) for n in names]).alias("y")).collect()
    return [r["y"] for r in sorted(got, key=lambda r: r["i"])]


def test_money(spark):
    assert over(spark, ["$123.45", "1,234.50", "$100 + tip", "", None, "TBD"], values.parse_money) == [123.45, 1234.5, 100.0, 0.0, 0.0, 0.0]


def test_phone(spark):
    rows = ["(773) 555-0100", "+1 773-555-0100", "17735550100", "773555010", "", None, "555-0100"]
    assert over(spark, rows, contact.normalize_phone) == ["7735550100"] * 3 + [None] * 4
    assert over(spark, rows[:1], contact.to_e164) == ["+17735550100"]


def test_address(spark):
    rows = ["123 N Main St, Chicago, IL 60601", "Main Street, Chicago, IL 60601", "", "5 Oak Ave, IL 60601", None]
    got = [tuple(r) for r in over(spark, rows, contact.normalize_address)]
    assert got == [
        ("123", "north main street", "chicago", "IL", "60601"), (None, None, "chicago", "IL", "60601"), (None,) * 5,
        ("5", "oak avenue", None, "IL", "60601"), (None,) * 5,
    ]
    names = ["Maple", "Maple Ave", "S Maple Ave", "5th Ave", "N", "St", ""]
    assert over(spark, names, contact.normalize_street_name) == ["maple", "maple avenue", "south maple avenue", "th avenue", "north", "street", ""]


def test_gates(spark):
    both = ["(773) 555-0100 at 123 Main St, Chicago, IL 60601", "call 555-0100, Addr: somewhere"]
    one = ["773-555-0100", "123 Main Street"]
    none = ["ok", "", None]
    assert over(spark, both + one + none, contact.is_job_message) == [True, True, False, False, False, False, False]
    assert over(spark, both + one + none, contact.has_matching_key) == [True] * 4 + [False] * 3


def test_chat_marks(spark):
    rows = ["Bob Smith +1 (773) 555-0100Lockout at 5 Oak Update? @Bob 1:20 p. m.", "clean text"]
    assert over(spark, rows, contact.without_chat_marks) == ["Lockout at 5 Oak", "clean text"]


def test_iso(spark):
    rows = ["2026-07-10T12:00:00", "2026-07-10T12:00:00Z", "2026-07-10T12:00:00-05:00", "tomorrow 3pm", "2026", "2026-07", "12:00", "20260710", None, ""]
    at = lambda h: datetime(2026, 7, 10, h)
    assert over(spark, rows, lambda x: values.parse_iso(x).cast("timestamp_ntz")) == [at(17), at(12), at(17), None, None, None, None, at(5), None, None]


def test_business_days_of_a_year(spark):
    zone = ZoneInfo("America/Chicago")
    hours = [datetime(2024, 1, 1) + timedelta(minutes=30 * k) for k in range(0, 366 * 48, 7)]
    got = over(spark, hours, values.business_day, "x timestamp_ntz")
    want = [(h.replace(tzinfo=UTC).astimezone(zone).replace(tzinfo=None) - timedelta(hours=5)).date() for h in hours]
    assert got == want
    days = [date(2026, 7, 15), date(2026, 1, 15)]
    assert over(spark, days, lambda x: values.business_day_start(x).cast("timestamp_ntz"), "x date") == [datetime(2026, 7, 15, 10), datetime(2026, 1, 15, 11)]


def test_payment_tokens(spark):
    yes = ["Paid 100$", "Parts 45", "149 cash", "Close 240 cash", "4100$cc", "Paid $600", "total: 174"]
    no = ["check the meter", "Close", "call 1", None]
    got = over(spark, yes + no, signals.payment_tokens)
    assert all(got[: len(yes)]) and got[len(yes) :] == [None] * len(no)


def test_reject(spark):
    yes = ["pass", "Have it!", "60601 pass", "cant do, too old", "sorry we have no one for now", "can't take"]
    no = ["on my way", "", None, "the customer will pass by the shop at noon and pick up all of the keys that we made"]
    assert over(spark, yes + no, signals.is_reject_phrase) == [True] * len(yes) + [False] * len(no)
    job = "Lockout at 123 North Main Street Chicago, customer Jane, house door"
    pairs = [(f"{job} too far", job), (job, job), ("other text", job), (f"{job} wrong number", job), (f"{job} Appt 11:30 am", job), (f"{job} Paid $600", job), ("x", "short")]
    got = over(spark, pairs, signals.is_reject_signal, "x string, j string")
    assert got == [True] + [False] * 6
    edited = job.replace("Jane", "Jana") + " no parts here"
    assert over(spark, [(edited, job)], signals.is_reject_signal, "x string, j string") == [True]


def test_tech_replies(spark):
    assert over(spark, ["OK!", "k.", "on it", "no", "ok then", None], signals.is_tech_accept) == [True, True, True, False, False, False]
    assert over(spark, ["no", "Can't", "skip", "ok", "no way"], signals.is_tech_reject) == [True, True, True, False, False]


def test_update_lines(spark):
    rows = [
        ("in_progress", None, None, None, None), ("appt_set", "3 pm", None, None, "gate 4"), ("appt_set", None, None, None, None),
        ("needs_follow_up", None, "Friday", "will_cb", None), ("canceled", None, None, "refused", None), ("canceled", None, None, "odd", ""), ("other", None, None, None, None),
    ]
    got = over(spark, rows, signals.update_line, "k string, a string, f string, r string, n string")
    assert got == [
        "Update: technician is on the way.", "Update: appointment set for 3 pm. Note: gate 4", "Update: appointment set.",
        "Update: needs follow-up (customer will call back). Will follow up around Friday.", "Update: job canceled — customer refused the price.",
        "Update: job canceled — odd.", "Update: other.",
    ]


def test_dedup_group(spark):
    rows = [("Acme ", "123 N Main St, Chicago", "(773) 555-1212")]
    assert over(spark, rows, extraction.dedup_group_id, "c string, a string, p string") == ["3487ecc5becd"]


def test_extraction_rules(spark):
    assert over(spark, ["Cash", "credit card (visa)", "Venmo", "barter", None], extraction.payment_method) == ["cash", "cc", "zelle", "no_apply", "no_apply"]
    rows = [("Car Key made", None), ("Car Key made", "Ford"), ("Lockbox", "Ford"), (None, None)]
    assert over(spark, rows, extraction.car_field, "k string, v string") == ["NOT_FOUND", "Ford", "NO_APPLY", "NO_APPLY"]
    got = over(
        spark, [("Lockbox", "NO_APPLY", "7735550100", "$12.50"), ("x", "Ford", "12", "12 or so"), ("Car Key made", "Ford", None, None)],
        lambda k, c, p, t: extraction.consistency_score(k, [c], p, t), "k string, c string, p string, t string",
    )
    assert got == [1.0, 0.0, 1.0]
    rows = ['say {"a": 1, "b": {"c": [1, "}"]}} bye', "```json\n{\"x\": null}\n```", "none {", None]
    assert over(spark, rows, extraction.first_json_object)[:3] == [{"a": "1", "b": "c=[1, '}']"}, {"x": None}, None]


def test_clean_up(spark):
    assert over(spark, ["<a href='x'>&\"", None], text.html_escaped) == ["&lt;a href=&#x27;x&#x27;&gt;&amp;&quot;", ""]
    assert over(spark, ["../../../etc/passwd", "hello world.txt", "é.txt", "...", "", "a\\b:c"], text.safe_filename) == ["passwd", "hello_world.txt", "e.txt", "unnamed", "", "a_b_c"]
    assert over(spark, ["a\x00b\n ", None], text.without_controls) == ["ab", ""]
    assert over(spark, ["12", "x", None, "-5"], lambda x: text.clamped(x, "int", 0, 10, 3)) == [10, 3, 3, 0]
    assert over(spark, ["“a” – b…​"], text.plain_marks) == ['"a" - b...']
    assert over(spark, ["LLama3.2:3b!"], text.slug) == ["llama3_2_3b"]
    assert text.like_escaped("50%_\\") == "50\\%\\_\\\\"
    assert over(spark, ["abcdefgh", "abc"], lambda x: text.shortened(x, 6)) == ["abc...", "abc"]
    assert over(spark, [45.0, 240.0, 150.0], values.duration_words, "x double") == ["45m", "4h", "2.5h"]


def test_json_answers(spark):
    rows = ['[{"a": 1}, 5, {"b": [1, null, " "]}]', 'ok: {"a": {"x": 2}} {"b": 1}', "see [1] and {not json} [2]", "none", None, "[" * 5000, '{"a"' * 50]
    got = over(spark, rows, extraction.json_objects)
    assert got == [[{"a": "1"}, None, {"b": "1"}], [{"a": "x=2"}], [None], None, None, None, None]


def test_file_names_lose_all_compatibility_forms(spark):
    rows = ["Résumé.pdf", "ﬁle Ⅻ ｆｕｌｌ①.txt", "Ångström/Łódź ½.doc", "日本", "a\x00b", None]
    assert over(spark, rows, text.safe_filename) == ["Resume.pdf", "file_XII_full1.txt", "odz_12.doc", "unnamed", "ab", ""]
