"""Rule tables as data, compiled to one CASE expression each. Korean terms are the domain's own."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quantloom.functions import cols as C

# ---- fixed values: patterns and word lists ----
NOT_COMMON_NAME = "리츠|REIT|인프라|스팩|기업인수목적|투자회사|선박투자|유전"
ROUTINE_TITLE = r"일괄신고|파생결합|투자설명서|증권신고서\(채무증권|증권발행실적보고서|임원ㆍ주요주주특정증권등소유상황보고서"
INSIDER_TITLE = "임원ㆍ주요주주특정증권등소유상황보고서"
MARKET_AUTO = (r"[+\-−]?\d+(?:\.\d+)?\s?%|상한가|하한가|순매수\s?상위|순매도\s?상위|매수\s?상위|매도\s?상위|순매수,\s?도|순매수·순매도"
               r"|\[장중수급포착\]|<유>|특징주")
KEY_CLASSES = ("주요사항", "자사주", "자금조달", "수주", "리스크", "M&A", "투자")
# (priority, how the terms are met, terms, terms that must be absent, label)
FILING_RULES = (
    (1, "starts", ("[",), (), "정정공시"),
    (2, "starts", ("주요사항보고서",), (), "주요사항"),
    (3, "contains", ("자기주식",), (), "자사주"),
    (4, "contains", ("유상증자", "사채", "증권발행결과", "권리락", "발행가액"), ("증권발행실적보고서",), "자금조달"),
    (5, "contains", ("소송", "불성실공시", "거래정지", "회생", "횡령", "배임", "상장폐지", "관리종목", "감사의견"), (), "리스크"),
    (6, "contains", ("임원ㆍ주요주주", "대량보유", "최대주주"), (), "지배구조"),
    (7, "contains", ("단일판매ㆍ공급계약", "유동성공급계약"), (), "수주"),
    (8, "contains", ("신규시설투자", "유형자산취득", "타법인주식및출자증권취득"), (), "투자"),
    (9, "contains", ("합병", "분할", "영업양수", "영업양도", "주식교환"), (), "M&A"),
    (10, "starts", ("사업보고서", "반기보고서", "분기보고서"), (), "정기보고"),
    (11, "contains", ("감사보고서",), (), "감사"),
)
EVENT_RULES = (
    (1, "starts", ("[",), (), None),
    (2, "equals", ("주요사항보고서(자기주식취득결정)", "주요사항보고서(자기주식취득신탁계약체결결정)"), (), "E1_자사주취득"),
    (3, "equals", ("주요사항보고서(유상증자결정)",), (), "E2_유상증자"),
    (4, "starts", ("단일판매ㆍ공급계약체결",), ("자회사", "종속회사", "해지"), "E3_공급계약"),
)
ACCOUNT_ITEMS = {"매출액": "revenue", "영업이익": "op", "당기순이익(손실)": "ni", "당기순이익": "ni",
                 "자산총계": "assets", "부채총계": "liab", "자본총계": "equity"}
REPORT_QUARTER = {"11013": 1, "11012": 2, "11014": 3, "11011": 4}
FUND_RULES = (
    (1, "matches", (r"레버리지|인버스|2X|곱버스|\(H\)?선물인버스",), (), "레버리지·인버스"),
    (2, "matches", (r"채권|국채|국고채|회사채|금리|머니마켓|MMF|CD|KOFR|단기채|통안채|은행채|크레딧|SOFR|단기자금",), (), "채권·금리"),
    (3, "matches", (r"금현물|골드|금선물|^.*\s금\b|은선물|실버|원유|WTI|구리|농산물|원자재|천연가스",), (), "원자재"),
    (4, "matches", (r"미국|S&P|나스닥|NASDAQ|다우|중국|차이나|홍콩|항셍|일본|니케이|인도|베트남|유로|유럽|글로벌|선진국|신흥국|"
                    r"대만|독일|MSCI|필라델피아|빅테크|테슬라|엔비디아|애플|마이크로소프트|구글|아마존|월드|해외|TOP10|라틴|브라질",), (), "해외 주식"),
    (5, "matches", (r".*",), (), "국내 주식"),
)
LEVERAGED = "레버리지·인버스"
EXCLUDE_WORDS = ("증권", "자산운용", "투자증권", "거래소", "리딩", "유료방", "카톡방", "방송", "Biz", "경제TV", "한경", "매경", "머니투데이", "뉴스공장",
                 "뉴스", "NEWS", "KBS", "MBC", "SBS", "JTBC", "YTN", "MBN", "TV조선", "채널A")
DOMESTIC_WORDS = ("주식", "종목", "코스피", "코스닥", "증시", "국장", "매수", "매도", "차트", "수급", "공시", "상한가", "하한가", "테마주", "급등주",
                  "삼성전자", "하이닉스", "2차전지")
FOREIGN_WORDS = ("미국", "미장", "나스닥", "S&P", "다우", "뉴욕증시", "엔비디아", "테슬라", "애플", "팔란티어", "비트코인", "코인")
LEXICON_NEUTRAL = ("최대주주", "최대 주주", "매수청구", "주식매수청구권", "상승 출발", "하락 출발", "보합", "혼조", "공개매수", "기대감 속", "우려 속",
                   "전망", "관심")
LEXICON_POSITIVE = (
    "상승", "급등", "강세", "반등", "오름세", "상한가", "신고가", "사상 최고", "최고치", "역대 최대", "역대급", "호실적", "실적 개선", "호조", "흑자",
    "흑자전환", "흑자 전환", "증가", "성장", "고성장", "수주", "공급계약", "공급 계약", "단일판매", "계약 체결", "상향", "목표가 상향", "목표주가 상향",
    "투자의견 상향", "매수 추천", "순매수", "사자", "기대", "개선", "돌파", "확대", "수혜", "호재", "서프라이즈", "어닝 서프라이즈", "배당 확대",
    "배당 증액", "자사주 매입", "자사주 소각", "자기주식 취득", "승인", "허가", "선정", "투자 유치", "껑충", "훨훨", "날개", "질주", "랠리", "쑥",
    "회복", "반등세", "강세장", "최대 실적", "사상 최대")
LEXICON_NEGATIVE = (
    "하락", "급락", "약세", "폭락", "내림세", "하한가", "신저가", "최저치", "부진", "적자", "적자전환", "적자 전환", "감소", "손실", "하향",
    "목표가 하향", "목표주가 하향", "투자의견 하향", "매도", "순매도", "팔자", "우려", "악화", "쇼크", "어닝 쇼크", "리스크", "소송", "제재", "과징금",
    "리콜", "유상증자", "감자", "횡령", "배임", "파업", "철회", "취소", "지연", "불확실", "경고", "추락", "곤두박질", "털썩", "급감", "위기", "논란",
    "조사", "압수수색", "상장폐지", "거래정지", "관리종목", "해지", "기대 이하", "기대 못 미쳐", "하회", "미달", "둔화", "역성장", "적신호", "주의보",
    "불안", "공포", "투매", "손절")
NOTE_SKIP_LINE = r"Research|Executive Summary|^주간 연결|^참고|^목차|^\d+\.\s"
# ---- end of fixed values ----


def _met(text: Column, how: str, terms) -> Column:
    match how:
        case "starts":
            return C.starts_any(text, terms)
        case "contains":
            return C.contains_any(text, terms)
        case "equals":
            return text.isin(*terms)
        case "matches":
            return C.first_match([(True, text.rlike(f"(?iu){p}")) for p in terms], False)
    raise ValueError(f"unknown kind of rule: {how}")


def by_rules(text: Column, rules, default: str | None = None) -> Column:
    """The label of the first rule, by priority, whose terms are met and whose other terms are absent: one CASE. NULL text: the default."""
    chain = [(label, _met(text, how, terms) & ~_met(text, "contains", absent) if absent else _met(text, how, terms)) for _, how, terms, absent, label in sorted(rules, key=lambda r: r[0])]
    return C.first_match(chain, default)


def rules_sql(column: str, rules, default: str | None = None) -> str:
    """The same CASE as SQL text, for checks outside Spark (not for patterns)."""
    quoted = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"

    def met(how, terms):
        if how == "equals":
            return f"{column} IN ({', '.join(map(quoted, terms))})"
        name = {"starts": "starts_with", "contains": "contains"}[how]
        return "(" + " OR ".join(f"{name}({column}, {quoted(t)})" for t in terms) + ")"

    lines = [f"WHEN {met(how, terms)}{' AND NOT ' + met('contains', absent) if absent else ''} THEN {quoted(label)}" for _, how, terms, absent, label in sorted(rules, key=lambda r: r[0])]
    return f"CASE {' '.join(lines)} ELSE {quoted(default)} END"


def classify_filing(title, rules=FILING_RULES) -> Column:
    """Class of a filing title by the rule table; pass a longer table to add classes."""
    return by_rules(F.trim(C.col(title)), rules, "기타")


def event_type(title, rules=EVENT_RULES) -> Column:
    """Study event of a filing title, NULL for corrections and everything else."""
    return by_rules(C.unspace(title), rules)


def is_routine(title) -> Column:
    return C.col(title).rlike(ROUTINE_TITLE)


def is_market_auto(title) -> Column:
    # every alternative of the pattern holds one of these; most long texts hold none, and need no pattern
    some = reduce(lambda a, b: a | b, [C.col(title).contains(x) for x in ("%", "한가", "매수", "매도", "장중수급포착", "<유>", "특징주")])
    return some & C.col(title).rlike(MARKET_AUTO)


def fund_category(name, index_name, rules=FUND_RULES) -> Column:
    return by_rules(F.concat(F.coalesce(C.col(name), F.lit("")), F.lit(" "), F.coalesce(C.col(index_name), F.lit(""))), rules, "기타")


def excluded_word(title, description=None) -> Column:
    """First excluded word found in the lower-cased text, NULL when none."""
    text = F.lower(F.concat_ws(" ", C.col(title), C.col(description) if description is not None else F.lit("")))
    return C.first_match([(w, text.contains(w.lower())) for w in EXCLUDE_WORDS])


def is_foreign_title(title) -> Column:
    return C.contains_any(F.lower(C.col(title)), [w.lower() for w in FOREIGN_WORDS])


def is_domestic_title(title) -> Column:
    return C.contains_any(C.col(title), DOMESTIC_WORDS) & ~is_foreign_title(title)


def lexicon() -> list[tuple[str, int]]:
    """(term, polarity), longest first, equal lengths in term order; a term listed twice keeps one polarity."""
    terms = {t: 0 for t in LEXICON_NEUTRAL}
    for words, p in ((LEXICON_POSITIVE, 1), (LEXICON_NEGATIVE, -1)):
        terms.update({w: p for w in words if w not in terms})
    return sorted(terms.items(), key=lambda kv: (-len(kv[0]), kv[0]))


def lexicon_score(title) -> Column:
    """struct(pos, neg, score). Each hit is blanked so that shorter terms cannot reuse it; neutral terms only consume."""
    # Only terms present in the title can ever hit (blanks of two or more characters form no new term), so the ordered
    # consumption runs over the few that are there.
    listed = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in lexicon()])

    def use(acc, e):
        gone = F.replace(acc["txt"], e["t"], F.lit(""))
        n = ((F.length(acc["txt"]) - F.length(gone)) / F.length(e["t"])).cast("int")
        rest = F.when(n > 0, F.replace(acc["txt"], e["t"], F.repeat(F.lit(" "), F.length(e["t"])))).otherwise(acc["txt"])
        return F.struct(rest.alias("txt"), (acc["pos"] + F.when(e["p"] > 0, n).otherwise(0)).alias("pos"),
                        (acc["neg"] + F.when(e["p"] < 0, n).otherwise(0)).alias("neg"))

    def finish(a):
        total = a["pos"] + a["neg"]
        return F.struct(a["pos"].alias("pos"), a["neg"].alias("neg"), F.when(total > 0, (a["pos"] - a["neg"]) / total).otherwise(0.0).alias("score"))

    def score(text):
        start = F.struct(text.alias("txt"), F.lit(0).alias("pos"), F.lit(0).alias("neg"))
        return F.aggregate(F.filter(listed, lambda e: F.contains(text, e["t"])), start, use, finish)

    # words without a letter of any term cannot be part of a hit: runs of them shrink to one mark before the terms are sought
    letters = "가-힣" + "".join(sorted({re.escape(c) for t, _ in lexicon() for c in t if not "가" <= c <= "힣" and c != " "}))
    text = F.regexp_replace(F.regexp_replace(C.squeeze(title), f"[^{letters} ]+", "\x01"), "\x01[\x01 ]*\x01", "\x01")
    # a one-element transform binds the shrunk title once; inlined, it would be rebuilt for every term
    return F.element_at(F.transform(F.array(text), score), 1)
