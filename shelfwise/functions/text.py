"""Column functions: product names, text quality, keywords, replies, event names, dates.

All are built-in expressions; ``(?U)`` gives Java's ``\\s`` and ``\\w`` their Unicode meaning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
QUALITY = {"body_len_min": 200, "body_len_max": 30000, "mean_line_len_min": 10, "ttr_min": 0.3, "num_ratio_max": 0.25, "korean_ratio_min": 0.3}
FAKE_EXACT = ["없음"]
FAKE_PARTS = ["해당없음", "해당사항없음", "관련없음", "정보없음", "후기본문추출실패", "n/a"]
PROMO_WORDS = ["1+1", "2+1", "3+1", "행사", "이벤트", "할인", "한정", "증정", "출시", "신상", "특가"]
SEASONS = [
    ("설날", ["설날", "구정", "설맞이", "새해", "신정", "정월", "복주머니", "세뱃돈", "복(福)", "설 특"]),
    ("발렌타인데이", ["발렌타인"]),
    ("화이트데이", ["화이트데이"]),
    ("봄페스티벌", ["봄맛", "봄 페스티벌", "봄페스티벌", "봄 시즌", "봄 행사", "봄특가", "벚꽃", "spring", "스프링", "나들이", "소풍", "피크닉", "신학기"]),
    ("야구/스포츠", ["야구", "k리그", "kbo", "직관", "스포츠", "응원"]),
    ("여름/휴가", ["여름", "썸머", "summer", "휴가", "바캉스", "집캉스", "빙과", "아이스크림", "빙수", "시원한", "쿨(cool)", "냉장", "냉면"]),
    ("추석", ["추석", "한가위", "명절"]),
    ("가을", ["가을", "단풍", "추수", "harvest", "수확", "가을맞이", "가을 시즌", "가을특가"]),
    ("핼러윈", ["핼러윈", "할로윈", "halloween", "호박", "귀신", "유령", "공포", "마녀"]),
    ("빼빼로데이", ["빼빼로"]),
    ("크리스마스", ["크리스마스", "christmas", "xmas"]),
    ("연말", ["연말", "송년", "겨울", "winter", "윈터", "year end", "연말연시"]),
]
ATTRIBUTES = ["매운맛", "단맛", "짠맛", "쓴맛", "신맛", "담백함", "고소함", "뜨거움", "차가움", "상온", "바삭함", "부드러움", "쫄깃함", "촉촉함", "크리미함", "바로취식(RTE)", "전자레인지", "에어프라이어", "끓는물", "해동필요", "고단백", "저칼로리", "제로슈거", "제로칼로리", "글루텐프리", "비건", "해당없음", "식사대용", "안주용", "당충전", "해장용", "다이어트용", "파티용", "1인용(소포장)", "대용량(패밀리)", "한입거리(바이트)", "번들형"]
WEEKDAYS = ["월", "화", "수", "목", "금", "토", "일"]
LIST_FIELDS = ["flavor_and_category", "collab_and_brand", "promotion_type", "tpo_context"]
BRAND = "세븐일레븐"
NAME_PREFIXES = [r"^\d{2}년\s+\d{1,2}월\s+", r"^\d{1,2}(~\d{1,2})?월\s+"]
NAME_SUFFIX = r"\s*\(\d+\)\s*$"
NAME_PATTERN = r"(\d{4}|\d{1,2}월|\d+차|\d+회|\(|\[)"
MONTH_IN_NAME = r"(?<!\d)(1[0-2]|[1-9])월"


#: Unicode's separators of words (Zs); all its blanks (White_Space); those of ASCII.
SPACES = " \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"
BLANKS = "\t\n\x0b\x0c\r\x85\u2028\u2029" + SPACES
ASCII_BLANKS = "\t\n\x0b\x0c\r "


def strip(c: Column, blanks: str = BLANKS) -> Column:
    """Without blanks, by default of any script, at either end."""
    return F.btrim(c, F.lit(blanks))


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), with c computed once however often f names it: a lambda's argument is."""
    return F.get(F.transform(F.array(c), f), 0)


def share(part: Column, whole: Column, scale: int = 4, empty: float = 0.0) -> Column:
    """The quotient, rounded as SQL engines round doubles (scaled first); ``empty`` for a whole of zero."""
    return F.coalesce(F.round(F.try_divide(part, whole) * 10**scale) / 10**scale, F.lit(empty))


def parse_product_name(q: Column) -> Column:
    """Brand prefix off; null gives ''."""
    inner = F.regexp_extract(strip(q), rf"^(?U){BRAND}\s+(.+)", 1)
    return F.coalesce(F.when(inner != "", strip(inner)).otherwise(strip(q)), F.lit(""))


def full_lines(body: Column, blanks: str = BLANKS) -> Column:
    return F.filter(F.split(body, "\n"), lambda x: F.length(strip(x, blanks)) > 0)


def line_features(body: Column, blanks: str = BLANKS) -> Column:
    """body_len, num_lines, mean_line_len, line_len_std (population) over lines that aren't blank; zeros for a blank body."""
    sizes = F.transform(full_lines(body, blanks), lambda x: F.length(x).cast("double"))
    zero = F.lit(0.0)

    def of(sizes: Column) -> Column:
        sums = F.aggregate(sizes, F.struct(zero.alias("s"), zero.alias("q")), lambda a, x: F.struct((a["s"] + x).alias("s"), (a["q"] + x * x).alias("q")))
        return F.struct(F.size(sizes).alias("n"), F.try_divide(sums["s"], F.size(sizes)).alias("mean"), F.try_divide(sums["q"], F.size(sizes)).alias("square"))

    # an element that a lambda names is computed once; fields of a plain struct would each split the body again
    blank = body.isNull() | (F.length(strip(body, blanks)) == 0)
    finished = lambda f: F.struct(F.when(blank, 0).otherwise(F.length(body)).alias("body_len"), F.when(blank, 0).otherwise(f["n"]).alias("num_lines"), F.when(blank, zero).otherwise(f["mean"]).alias("mean_line_len"), F.when(blank, zero).otherwise(F.sqrt(F.greatest(zero, f["square"] - f["mean"] * f["mean"]))).alias("line_len_std"))
    return F.get(F.transform(F.transform(F.array(sizes), of), finished), 0)


def type_token_ratio(body: Column, empty: float = 0.0) -> Column:
    """Distinct tokens by tokens; ``empty`` without any."""
    tokens = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit("[가-힣a-zA-Z0-9]+"), F.lit(0))
    return once(tokens, lambda t: share(F.size(F.array_distinct(t)), F.size(t), empty=empty))


def char_ratio(body: Column, kind: str, empty: float = 0.0) -> Column:
    """Share of the characters of a class such as ``0-9``; ``empty`` without any character."""
    text = F.coalesce(body, F.lit(""))
    return share(F.length(F.regexp_replace(text, f"[^{kind}]", "")), F.length(text), empty=empty)


def is_high_quality(size: Column, mean: Column, ttr: Column, num: Column, kor: Column, t: dict = QUALITY) -> Column:
    return (size >= t["body_len_min"]) & (size <= t["body_len_max"]) & (mean >= t["mean_line_len_min"]) & (ttr >= t["ttr_min"]) & (num <= t["num_ratio_max"]) & (kor >= t["korean_ratio_min"])


def quality_tag(ttr: Column, num: Column, kor: Column) -> Column:
    tag = F.concat_ws(", ", F.when(num > 0.25, "high_num_ratio"), F.when(kor < 0.3, "low_korean_ratio"), F.when(ttr < 0.3, "low_ttr"))
    return F.when(tag == "", "normal").otherwise(tag)


def clean_post_text(title: Column, body: Column, size: int = 500) -> Column:
    text = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(body, F.lit("")))
    text = F.replace(F.regexp_replace(text, r"(?U)@[\w.]+", ""), F.lit("#"), F.lit(""))
    return F.substring(strip(F.regexp_replace(text, r"(?U)\s+", " ")), 1, size)


def clean_blog_text(body: Column, size: int = 3000, least: int = 100) -> Column:
    text = F.substring(strip(F.regexp_replace(F.coalesce(body, F.lit("")), r"(?U)\s+", " ")), 1, size)
    return F.when(F.length(text) < least, "").otherwise(text)


def norm_event(name: Column) -> Column:
    """Month prefixes and a number in brackets at the end go; null stays null."""
    for prefix in NAME_PREFIXES:
        name = F.regexp_replace(name, prefix, "")
    return strip(F.regexp_replace(name, NAME_SUFFIX, ""))


def has_event_pattern(name: Column) -> Column:
    return name.rlike(NAME_PATTERN)


def months_in_name(name: Column) -> Column:
    """Numbers 1 to 12 before 월 that no digit precedes."""
    return F.transform(F.regexp_extract_all(name, F.lit(MONTH_IN_NAME), F.lit(1)), lambda m: m.cast("int"))


def tokenize(name: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(name, r"(?U)[^\w]", " "), " "), lambda t: F.length(t) >= 2)


def match_score(tokens: Column, text: Column) -> Column:
    """How many of the tokens the text holds, whatever the case."""
    return F.size(F.filter(tokens, lambda t: F.contains(F.lower(text), F.lower(t))))


def keyword_in_body(body: Column, query: Column) -> Column:
    """The first of the query, the query without brand, the part after the last bracket, its last word."""
    raw = strip(F.regexp_replace(query, rf"^(?U){BRAND}\s*", ""))
    product = strip(F.element_at(F.split(raw, r"\)"), -1))
    short = strip(F.element_at(F.split(product, r"(?U)[\s\(\)]"), -1))
    return F.coalesce(*[F.when((k != "") & F.contains(body, k), k) for k in (query, raw, product, short)])


def sentence_context(body: Column, word: Column, n: int = 2) -> Column:
    """The first sentence with the word and n sentences around it, marked; '' without a hit."""
    sentences = F.filter(F.transform(F.split(body, r"[\n。!?！？]+"), lambda s: strip(s)), lambda s: s != "")

    def around(found: Column) -> Column:
        hit = found["hit"]
        begin = F.greatest(F.lit(1), hit - n)
        near = F.slice(found["all"], begin, hit + n - begin + 1)
        marked = F.transform(near, lambda s, i: F.when(i + begin == hit, F.concat(F.lit("▶ "), s)).otherwise(s))
        return F.when(F.coalesce(hit, F.lit(0)) == 0, "").otherwise(F.array_join(marked, " / "))

    place = lambda s: F.struct(s.alias("all"), F.array_position(F.transform(s, lambda x: F.contains(x, word)), True).cast("int").alias("hit"))
    return once(once(sentences, place), around)


def season(name: Column) -> Column:
    def named(low: Column) -> Column:
        found = F.lit(None).cast("string")
        for label, words in reversed(SEASONS):
            hit = F.lit(False)
            for w in words:
                hit = hit | F.contains(low, F.lit(w))
            found = F.when(hit, label).otherwise(found)
        return found

    return once(F.lower(name), named)


def split_keywords(s: Column) -> Column:
    """Parts of a comma list, trimmed, blank ones dropped."""
    return F.filter(F.transform(F.split(F.coalesce(s, F.lit("")), ","), lambda k: strip(k)), lambda k: k != "")


def keyword_count(s: Column) -> Column:
    return F.size(split_keywords(s))


def fake_tokens(s: Column) -> Column:
    def fake(k: Column) -> Column:
        flat = F.replace(F.lower(k), F.lit(" "), F.lit(""))
        hit = flat.isin(FAKE_EXACT)
        for part in FAKE_PARTS:
            hit = hit | F.contains(flat, F.lit(part))
        return hit

    return F.filter(split_keywords(s), fake)


def has_fake(s: Column) -> Column:
    return F.size(fake_tokens(s)) > 0


def needs_reextract(review: Column, hin: Column, body: Column, few: int = 3, least: int = 1000) -> Column:
    low = (keyword_count(review) <= few) | (keyword_count(hin) <= few)
    return (low & (F.length(strip(F.coalesce(body, F.lit("")))) >= least)) | has_fake(review) | has_fake(hin)


def extract_json_block(reply: Column) -> Column:
    """From the first brace to the last; null without both."""

    def block(text: Column) -> Column:
        begin = F.locate("{", text)
        end = F.length(text) - F.locate("}", F.reverse(text)) + 1
        return F.when((begin > 0) & (F.locate("}", text) > 0) & (end >= begin), F.substring(text, begin, end - begin + 1))

    return once(reply, block)


#: Stands for a string literal while a block's structure is repaired. Control characters are out of the block by then.
HELD = "\x01"
LITERAL = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def held_apart(block: Column) -> Column:
    """Struct of a block's skeleton, with a mark for each whole string literal, and those literals in order."""
    block = F.regexp_replace(block, r"\p{Cntrl}", " ")
    return F.struct(F.regexp_replace(block, LITERAL, HELD).alias("skeleton"), F.regexp_extract_all(block, F.lit(LITERAL), F.lit(0)).alias("literals"))


def put_back(held: Column) -> Column:
    """The text of ``held_apart``'s struct: the literals take the places of the marks."""
    return F.array_join(F.transform(F.split(held["skeleton"], HELD, -1), lambda x, i: F.concat(x, F.coalesce(F.get(held["literals"], i), F.lit("")))), "")


def mended(held: Column) -> Column:
    """Commas before a closing bracket go; commas between neighbouring values come in; a key that lacks its value gets null."""
    bones = F.regexp_replace(held["skeleton"], r"(?:,\s*)+(?=[}\]])", "")
    bones = F.regexp_replace(bones, rf"(?<=[}}\]])\s*(?=[\[{{{HELD}])|(?<={HELD})\s+(?={HELD})", ",")
    bones = F.regexp_replace(bones, rf"([{{,]\s*{HELD})\s*:?\s*(?=}})", "$1:null")
    return F.struct(bones.alias("skeleton"), held["literals"].alias("literals"))


def completed(held: Column) -> Column:
    """A block that breaks off: its open string is a literal too, without a lone backslash at its end, and open brackets are closed.

    The brackets that are open are the state of a fold over the brackets outside strings, innermost first.
    """
    cut = F.locate('"', held["skeleton"])
    head = F.when(cut > 0, F.substring(held["skeleton"], F.lit(1), cut - 1)).otherwise(held["skeleton"])
    rest = F.regexp_replace(F.substring(held["skeleton"], cut, F.length(held["skeleton"])), r"(?s)^((?:[^\\]|\\.)*+)\\?$", '$1"')

    def step(open_: Column, c: Column) -> Column:
        return F.when(c == "{", F.concat(F.lit("}"), open_)).when(c == "[", F.concat(F.lit("]"), open_)).when((c != "") & (F.substring(open_, 1, 1) == c), F.substring(open_, F.lit(2), F.length(open_))).otherwise(open_)

    closing = F.aggregate(F.split(F.regexp_replace(head, r"[^\[\]{}]", ""), ""), F.lit(""), step)
    skeleton = F.concat(head, F.when(cut > 0, HELD).otherwise(""), closing)
    return F.struct(skeleton.alias("skeleton"), F.when(cut > 0, F.concat(held["literals"], F.array(rest))).otherwise(held["literals"]).alias("literals"))


def repair_json(reply: Column) -> Column:
    """The reply's JSON object as text: as it is, mended, or completed and mended, whichever first parses; else null.

    String literals are held apart while the rest is repaired, so what stands inside them isn't
    touched. A block may lack its closing braces, so it is completed from its first brace to the
    reply's end. All of it is built-in expressions.
    """
    parses = lambda c: F.from_json(c, "map<string,string>").isNotNull() & F.from_json(c, "struct<_corrupt_record string>", {"mode": "PERMISSIVE"})["_corrupt_record"].isNull()
    checked = lambda c: F.when(parses(c), c)

    def repaired(held: Column) -> Column:
        whole, tail = held["whole"], held["tail"]
        mend = once(once(once(held_apart(whole), mended), put_back), checked)
        complete = once(once(once(once(held_apart(tail), completed), mended), put_back), checked)
        return F.coalesce(checked(whole), mend, complete)

    tail = lambda text: F.when(F.locate("{", text) > 0, F.substring(text, F.locate("{", text), F.length(text)))
    parts = lambda text: F.struct(F.coalesce(extract_json_block(text), tail(text)).alias("whole"), tail(text).alias("tail"))
    return once(once(reply, parts), repaired)


def bin_length(n: Column, edges: list[int]) -> Column:
    """Number of the left-closed bin, from 0; below the first edge or null gives null."""
    out = F.lit(None).cast("int")
    for i, low in enumerate(edges):
        out = F.when(n >= low, i).otherwise(out)
    return out


METADATA = "array<struct<name string, price string, capacity string, flavor_and_category string, collab_and_brand string, promotion_type string, tpo_context string>>"
REPLY = f"struct<metadata {METADATA}, flavor_and_category string, collab_and_brand string, promotion_type string, tpo_context string>"


def reply_struct(reply: Column) -> Column:
    """Both layouts of a reply: lists at the root, or inside each product. A list field may be a plain string."""
    return F.from_json(extract_json_block(reply), REPLY)


def as_list(field: Column) -> Column:
    """A JSON list as array, a plain string as one entry, blank or null as none."""
    parsed = F.when(field.startswith("["), F.from_json(field, "array<string>")).otherwise(F.array(field))
    return F.filter(F.coalesce(parsed, F.array().cast("array<string>")), lambda x: F.length(strip(F.coalesce(x, F.lit("")))) > 0)


def structured_keyword_count(reply: Column) -> Column:
    """Entries of the four list fields, at the root and in every product; plain strings don't count."""
    r = reply_struct(reply)
    entries = lambda field: F.coalesce(F.size(F.from_json(F.when(field.startswith("["), field), "array<string>")), F.lit(0))
    of = lambda holder: sum((F.greatest(entries(holder[f]), F.lit(0)) for f in LIST_FIELDS), F.lit(0))
    return of(r) + F.aggregate(F.coalesce(r["metadata"], F.array().cast(METADATA)), F.lit(0), lambda a, m: a + of(m))


def is_multi_product(reply: Column) -> Column:
    return F.coalesce(F.size(reply_struct(reply)["metadata"]) >= 2, F.lit(False))


def event_value(value: Column, field: str) -> Column:
    return F.get_json_object(F.replace(value, F.lit('""'), F.lit('"')), f"$.{field}")


def reply_summary(reply: Column) -> Column:
    r = reply_struct(reply)
    names = F.filter(F.transform(F.coalesce(r["metadata"], F.array().cast(METADATA)), lambda m: F.coalesce(m["name"], F.lit(""))), lambda n: n.isNotNull())
    flavours = as_list(r["flavor_and_category"])
    line = F.concat_ws(" | ", F.when(F.size(names) > 0, F.concat(F.lit("상품:"), F.array_join(F.slice(names, 1, 2), "/"))), F.when(F.size(flavours) > 0, F.concat(F.lit("맛/카테고리:"), F.array_join(F.slice(flavours, 1, 3), ", "))))
    return F.when(line == "", "(내용 없음)").otherwise(line)


def is_promo_post(reply: Column, title: Column, body: Column, promo_words: list[str] = PROMO_WORDS) -> Column:
    inner = F.exists(F.coalesce(reply_struct(reply)["metadata"], F.array().cast(METADATA)), lambda m: F.size(as_list(m["promotion_type"])) > 0)
    text = F.concat(F.coalesce(title, F.lit("")), F.coalesce(body, F.lit("")))
    words = F.lit(False)
    for w in promo_words:
        words = words | F.contains(text, F.lit(w))
    return F.coalesce(inner, F.lit(False)) | words


def weekday(date: Column) -> Column:
    """1 for Monday to 7."""
    return F.weekday(date) + 1


def weekday_name(date: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, WEEKDAYS)), weekday(date))


def hour(time: Column) -> Column:
    """Of HHMMSS that may have lost leading zeros."""
    return F.substring(F.lpad(time, 6, "0"), 1, 2).try_cast("int")


def pad_code(code: Column, width: int = 6) -> Column:
    """Zeros in front up to the width; longer codes are never cut."""
    return F.when(F.length(code) < width, F.lpad(code, width, "0")).otherwise(code)
