"""Text columns: note summaries, headlines, file names. All are higher-order functions on the array of lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quantloom.functions import cols as C
from quantloom.functions import rules as R


def lines(text) -> Column:
    return F.transform(F.split(F.coalesce(C.col(text), F.lit("")), r"\r\n|[\n\r]"), C.squeeze)


def _letters(x) -> Column:
    return F.length(F.regexp_replace(x, "[^가-힣A-Za-z]", ""))


def _cut(joined, n: int) -> Column:
    return F.when(F.length(joined) <= n, joined).otherwise(F.concat(F.rtrim(F.substring(joined, 1, n)), F.lit("…")))


def _prose(arr) -> Column:
    """Lines with at least 4 letters that make a quarter of the non-blank characters, repeats dropped."""
    ok = lambda x: (_letters(x) >= 4) & (_letters(x) >= 0.25 * F.length(F.replace(x, F.lit(" "), F.lit(""))))
    return F.array_join(F.array_distinct(F.filter(arr, ok)), " ")


def summarize(text, n: int = 220) -> Column:
    return _cut(_prose(lines(text)), n)


def headline(text, title=None) -> Column:
    """struct(headline, lede): first sentence-like line of at most 120 characters; the following lines give the lede."""
    ls = F.filter(lines(text), lambda x: x != "")
    if title is not None:
        t = C.col(title)
        same = F.coalesce((F.element_at(F.concat(ls, F.array(F.lit(""))), 1) == t) | F.element_at(F.concat(ls, F.array(F.lit(""))), 1).startswith(F.substring(t, 1, 10)), F.lit(False))
        ls = F.when(same, F.slice(ls, 2, F.greatest(F.size(ls) - 1, F.lit(0)))).otherwise(ls)
    body = F.filter(ls, lambda x: ~x.rlike(R.NOTE_SKIP_LINE) & (F.length(F.regexp_replace(x, "[^가-힣]", "")) >= 6))
    start = F.struct(F.lit(None).cast("string").alias("head"), F.array().cast("array<string>").alias("rest"), F.lit(0).alias("len"))

    def step(acc, x):
        new = acc["head"].isNull() & (F.length(x) <= 120)
        more = acc["head"].isNotNull() & (acc["len"] <= 160)
        return F.struct(F.when(new, x).otherwise(acc["head"]).alias("head"),
                        F.when(more, F.concat(acc["rest"], F.array(x))).otherwise(acc["rest"]).alias("rest"),
                        F.when(more, acc["len"] + F.length(x)).otherwise(acc["len"]).alias("len"))

    return F.aggregate(body, start, step, lambda a: F.struct(a["head"].alias("headline"), _cut(_prose(a["rest"]), 200).alias("lede")))


def parse_name(stem) -> Column:
    """struct(date, title) from a file name: week names, dated names, or the bare name."""
    s = F.trim(C.col(stem))
    week, dated = r"^(\d{4})-(\d{2})_(\d)주차[ _\-]+(.+)$", r"^(\d{4})[-.]?(\d{2})[-.]?(\d{2})[ _\-]+(.+)$"
    plain = lambda x: F.trim(F.replace(x, F.lit("_"), F.lit(" ")))
    part = lambda p, i: F.regexp_extract(s, p, i)
    date = F.concat_ws("-", part(dated, 1), part(dated, 2), part(dated, 3)).try_cast("date")
    is_week, is_dated = s.rlike(week), s.rlike(dated) & date.isNotNull()
    title = (F.when(is_week, F.concat(part(week, 2).try_cast("int").cast("string"), F.lit("월 "), part(week, 3), F.lit("주차 "), plain(part(week, 4))))
             .when(is_dated, plain(part(dated, 4))).otherwise(plain(s)))
    return F.struct(F.when(~is_week & is_dated, date).alias("date"), title.alias("title"))


def clean_title(t) -> Column:
    x = F.trim(F.regexp_replace(F.trim(F.coalesce(C.col(t), F.lit(""))), "^(Microsoft (Word|PowerPoint|Excel) - |제목 없음)", ""))
    x = F.regexp_replace(x, r"(?i)\.(docx?|pptx?|xlsx?|hwp|pdf)$", "")
    return F.when(F.length(x).between(2, 80) & ~F.lower(x).isin("untitled", "document"), x)


def last_date(t) -> Column:
    found = F.regexp_extract_all(C.col(t), F.lit(r"(\d{4}-\d{2}-\d{2})"), 1)
    return F.try_element_at(found, F.lit(-1))


def category(path) -> Column:
    """First folder below the root, `public/` skipped; files at the top are 기타."""
    parts = F.split(F.regexp_replace(C.col(path), "^public/", ""), "/")
    return F.when(F.size(parts) > 1, parts[0]).otherwise("기타")
