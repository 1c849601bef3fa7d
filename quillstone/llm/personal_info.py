"""Personal information in free text: find it and put typed placeholders in its place.

Regular expressions propose spans of every kind; validators (check digits by Luhn, mod 97
and mod 11, the form of a mail domain, the parts of an address) and the words near a span
raise or lower its score; spans under the threshold fall away and, of overlapping ones,
the strongest stays.  Names come from a list of known names, from
the stems and endings that this list shares (the list is incomplete), and from forms
of address and labels.

Edge cases: null text gives no spans and stays null, empty text stays empty; repeated
rows give repeated results; offsets count code points; whole texts are read.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 1.0
_RANK = {"email": 5, "id_number": 4, "phone": 3, "address": 2, "name": 1}

# --- e-mail -------------------------------------------------------------------------------
_AT = re.compile(r"\s?[@＠﹫]\s?|\s?[\[({<]\s?(?:at|AT)\s?[\])}>]\s?|\s(?:at|AT)\s(?=[A-Za-z0-9-]+(?:\s(?:dot|DOT)\s|\s?[\[(]\s?(?:dot|DOT)))")
_LOCAL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+\-]*[A-Za-z0-9_+\-])?$")
_DOMAIN = re.compile(
    r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
    r"(?:(?:[.．]|\s?[\[({]\s?(?:dot|DOT)\s?[\])}]\s?|\s(?:dot|DOT)\s)[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+")


_MAIL_WORDS = re.compile(r"(?i)(?:mail|contact|reach|write to|reply|cc|メール|連絡|邮箱|郵件|联系|이메일|البريد|อีเมล|surel|thư)[^\n]{0,24}$")
_HOST_WORDS = re.compile(r"(?i)(?:://\S*|\b(?:ssh|scp|git|sftp|rsync)\b[^\n]{0,12})$")


def _valid_mail(local: str, labels: list[str]) -> bool:
    """Lengths and signs that a mail address may have."""
    return len(local) <= 64 and ".." not in local and len(labels) > 1 and all(0 < len(x) <= 63 for x in labels) and labels[-1].isalpha() and 2 <= len(labels[-1]) <= 24


def _emails(text: str) -> Iterator[tuple[int, int, str, float]]:
    for m in _AT.finditer(text):
        left = _LOCAL.search(text[max(0, m.start() - 65): m.start()])
        right = _DOMAIN.match(text, m.end())
        if left and right:
            start = m.start() - len(left.group())
            labels = [x for x in re.split(r"[^A-Za-z0-9-]+|\b(?:dot|DOT)\b", right.group()) if x]
            near = text[max(0, start - 40): start]
            score = 0.7 if m.group().strip() in "@＠﹫" else 0.5
            score += 0.6 if _valid_mail(left.group(), labels) else -0.6
            score += 0.4 * bool(_MAIL_WORDS.search(near)) - 0.8 * bool(_HOST_WORDS.search(near))
            yield start, right.end(), "email", score


# --- numbers ------------------------------------------------------------------------------
_SEP = r"[  .\-()（）‐-―−]"
_NUMBER = re.compile(rf"(?<![A-Za-z0-9_\-./:#=\[])(?:[+＋]\s?)?[(（]?\d(?:{_SEP}{{0,2}}\d){{6,19}}(?!\w*[A-Za-z]{{3}}\d)|(?<=[=:])[+＋]?[(（]?\d(?:{_SEP}{{0,2}}\d){{6,19}}")
_DATE = re.compile(r"(?:19|20)\d\d[-./ ](?:0?[1-9]|1[0-2])[-./ ](?:0?[1-9]|[12]\d|3[01])(?!\d)")
_PHONE_LEFT = re.compile(
    r"(?i)(?:\b(?:tel|phone|telephone|mobile|cell|fax|call|ring|dial|text|hp|telp|telepon|whatsapp)\b\W{0,4}|number is |\bor |reach \w+ (?:at|on) "
    r"|电话|電話|手机|手機|携帯|连絡先|連絡先|联系方式|전화|휴대폰|연락처|님에게 |الهاتف|هاتف|جوال|على الرقم|โทร\S{0,6}|ที่ |qua số |ĐT|điện thoại|Hubungi|\bdi )[^\w+（(]{0,4}は?[^\w+（(]{0,3}$")
_PHONE_RIGHT = re.compile(r"\s?(?:に電話|へ電話|まで(?:お)?電話|로 연락|으로 연락|(?:ext|x)\.? ?\d)")
_NOT = re.compile(
    r"(?i)(?:\b(?:order|isbn|seed|sha|host|build|version|ver|units?|lat|lon|file|note|invoice|ticket|case|art|score|arr|issn|doi|no\. of)\b[^\d]{0,3}|§\s?|#)$")
_ID_LEFT = re.compile(
    r"(?i)(?:social security(?: (?:no|number))?|\bssn|passport(?: (?:no|number|is))?|\btax (?:id|no|number)|national (?:id|insurance)(?: (?:no|number))?|\bid(?:entity)?(?: (?:card|no|number))?|\bnino|\bnik|\bnpwp|\bcccd|\bcmnd"
    r"|身份证号?码?|证件号?码?|护照号?码?|税号|社保号|個人番号|マイナンバー|本人確認番号|旅券番号|免許証番号|パスポート番号|주민등록번호|외국인등록번호|여권번호|الهوية|جواز السفر|الضريبي|เลขประจำตัว\S*|หนังสือเดินทาง|căn cước|hộ chiếu|mã số thuế|\bno\. ktp|paspor)[^\w]{0,3}(?:is|は|是|為|为)?[^\w]{0,3}$")
_CODE = re.compile(r"(?<![A-Za-z0-9\-])(?:[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]|[A-Z]{1,2}\s?\d{6,9})(?![\w\-])")


def _luhn(d: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(d)):
        v = int(ch) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _mod97(d: str) -> bool:
    return len(d) > 4 and int(d[:-2]) % 97 == 97 - int(d[-2:])


def _weighted(d: str, weights: list[int]) -> int:
    return sum(int(a) * b for a, b in zip(d, weights)) % 11


def _checked(d: str) -> bool:
    """Whether the check digits of a known national number of this length hold."""
    n = len(d)
    if n == 18:
        w = [2 ** (17 - i) % 11 for i in range(17)]
        return d[:17].isdigit() and "10X98765432"[_weighted(d, w)] == d[17].upper()
    if n == 13:
        korea = (11 - _weighted(d, [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5])) % 10 == int(d[12])
        return korea or (11 - _weighted(d, list(range(13, 1, -1)))) % 10 == int(d[12])
    if n == 12:
        r = _weighted(d, [6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2])
        return int(d[11]) == (0 if r <= 1 else 11 - r)
    return n in (10, 16) and _luhn(d) or n == 15 and _mod97(d)


_ID_SHAPES = {"3-2-4": 0.7, "6-7": 0.8, "1-4-5-2-1": 0.8, "18": 0.7, "16": 0.4, "12": 0.3, "4-4-4": 0.3, "13": 0.4, "10": 0.2}


def _phone_score(raw: str, d: str, shape: str) -> float:
    if raw[0] in "+＋":
        return 1.2 if 8 <= len(d) <= 15 else 0.0
    if not 7 <= len(d) <= 12:
        return 0.0
    if shape in ("3-3-4", "1-3-3-4"):
        return 1.0
    if d[0] == "0" and 9 <= len(d) <= 12 and "-" in shape:
        return 0.9
    if raw[0] in "(（":
        return 0.8
    return 0.6 if d[0] == "0" and 9 <= len(d) <= 11 else 0.4


def _numbers(text: str) -> Iterator[tuple[int, int, str, float]]:
    for m in _NUMBER.finditer(text):
        raw, start, end = m.group(), m.start(), m.end()
        d = "".join(str(unicodedata.decimal(c)) for c in raw if c.isdecimal())
        groups = [g for g in re.split(r"\D+", raw) if g]
        shape = "-".join(str(len(g)) for g in groups)
        left, right = text[max(0, start - 32): start], text[end: end + 12]
        if _DATE.match(raw) or (len(groups) == 2 and raw.count(".") == 1 and len(groups[1]) > 4):
            continue
        against = 2.0 if _NOT.search(left) else 0.0
        if right[:1] in ("X", "x") and len(d) == 17:
            d, shape, end = d + "X", "18", end + 1
        id_words = bool(_ID_LEFT.search(left))
        phone_words = bool(_PHONE_LEFT.search(left)) or bool(_PHONE_RIGHT.match(right))
        as_id = _ID_SHAPES.get(shape, 0.0) + 0.5 * _checked(d) + (1.0 if id_words else 0) - against
        if shape == "6-7" and not (1 <= int(d[2:4]) <= 12 and 1 <= int(d[4:6]) <= 31):
            as_id -= 0.5
        as_phone = _phone_score(raw, d, shape) + (0.8 if phone_words else 0) - against - (1.0 if id_words else 0)
        if as_id >= max(THRESHOLD, as_phone):
            yield start, end, "id_number", as_id
        elif as_phone >= THRESHOLD - 0.1:
            # an opening bracket belongs to the number only if it is closed inside it
            if raw[0] in "(（" and not re.search(r"[)）]", raw):
                start += 1
            yield start, end, "phone", as_phone
    for m in _CODE.finditer(text):
        if _ID_LEFT.search(text[max(0, m.start() - 32): m.start()]):
            yield m.start(), m.end(), "id_number", 1.9
        elif len(re.sub(r"\s", "", m.group())) == 9 and m.group()[-1].isalpha() and m.group()[0] not in "DFIQUV":
            yield m.start(), m.end(), "id_number", 1.0
    for m in re.finditer(r"\bid=([\w-]{7,18})(?=;)", text):
        if re.fullmatch(r"[A-Z]{1,2}\d{6,9}|\d{3}-\d\d-\d{4}", m.group(1)):
            yield m.start(1), m.end(1), "id_number", 1.8


# --- street addresses ---------------------------------------------------------------------
_CAP = r"[A-ZÀ-ÞĐ][\w'’\-]*"
_HAN, _KANA = "一-鿿々", "ぁ-ゖァ-ヺー"
_ADDRESSES = [re.compile(p) for p in (
    # number, street name, kind of street
    rf"(?<![\w.,/\-])\d{{1,5}}[A-Za-z]?(?:[-/]\d{{1,4}})? (?:{_CAP}\.? ){{1,4}}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Quay|Drive|Dr|Court|Ct|Square|Sq|Place|Pl|Boulevard|Blvd|Terrace|Way|Close|Crescent|Row|Walk|Gardens|Parade|Highway|Hwy)(?![\w])\.?(?:, (?:Apt|Flat|Unit|Suite)\.? \w+)?(?:(?:, |\n)(?:{_CAP} ?){{1,3}}(?: \d{{5}})?)?",
    # Vietnamese, Indonesian, Arabic, Thai
    rf"(?:[Ss]ố (?:nhà )?)?(?<!\w)\d{{1,4}}(?:/\d+)? (?:đường|phố|ngõ) (?:{_CAP} ?){{1,4}}(?:, (?:phường|xã|quận) (?:{_CAP} ?){{1,4}})?(?:, (?:{_CAP} ?){{1,4}})?",
    rf"(?:Jl\.|Jalan|Jln\.?) ?(?:{_CAP} ){{1,4}}(?:No\.? ?)?\d{{1,4}}(?:, Kec\. {_CAP}(?:, {_CAP})?)?",
    r"شارع (?:[ء-ي]+ ){1,4}(?:رقم )?\d{1,4}(?:، حي [ء-ي]+(?: [ء-ي]+)?(?:، [ء-ي]+)?)?",
    r"\d{1,4}(?:/\d{1,4})? (?:ถนน|ซอย)[ก-๎]+(?: (?:เขต|แขวง|อำเภอ|ตำบล)[ก-๎]+)*",
    # Korean: city, district, road with number
    r"(?<![가-힣])[가-힣]{1,12}(?:시|도|군) (?:[가-힣]{1,12}(?:구|군|시|읍|면|동) ){0,2}[가-힣]{1,12}(?:로|길)(?:\d{1,3}번?길)? \d{1,4}(?:-\d+)?(?:, \d+동 \d+호)?",
)]
#: A text without any of these has no address of that pattern.
_SIGNS = [
    ("Street", "St", "Road", "R", "Ave", "L", "Quay", "Dr", "C", "Sq", "P", "B", "T", "Way", "Walk", "Gardens", "H"),
    ("đường", "phố", "ngõ"), ("Jl", "Jalan", "Jln"), ("شارع",), ("ถนน", "ซอย"), ("로", "길")]
_HAN_ADDRESS = re.compile(
    rf"(?P<label>住在|居住于|住于|地址[：: ]?|住址[：: ]?|送至|寄到|寄往|(?:^|(?<=[\s，。；、：:])))"
    rf"(?P<span>[{_HAN}]{{1,8}}(?:省|自治区|市)(?:[{_HAN}]{{1,8}}[市州县区]){{0,3}}[{_HAN}]{{1,10}}(?:路|街|道|巷|弄)\d{{1,4}}号?(?:\d+栋)?(?:\d+单元)?(?:\d+室)?)", re.M)
_JA_ADDRESS = re.compile(
    rf"(?P<label>住所は|住所[：:]|送付先[：:]|宛先[：:]|届け先[：:]|(?:^|(?<=[\s、。：:])))(?:〒?\d{{3}}-\d{{4}}\s?)?"
    rf"(?![^\n]{{0,16}}(?:住所|送付先))(?P<span>[{_HAN}{_KANA}]{{1,12}}[都道府県][{_HAN}{_KANA}]{{1,24}}?(?:\d{{1,3}}丁目(?:\d{{1,3}}番(?:地)?(?:\d{{1,3}}号)?)?|\d{{1,3}}(?:[-－‐]\d{{1,3}}){{1,2}})(?: [{_HAN}{_KANA}]+\d+号室)?)", re.M)


_PLACE_WORDS = re.compile(
    r"(?i)(?:\b(?:at|address|lives?|living|resides?|residing|deliver(?:ed|y)?|ship(?:ped)?|sent|visit|located|moved|from|to|alamat|tinggal|địa chỉ)\b|العنوان|يسكن|ที่อยู่|주소|거주)[^\n]{0,16}$")
_PART_WORDS = re.compile(r"(?i)\b(?:page|chapter|section|figure|table|line|lines|version|volume|row|step|about|over|of)\s$")
_FURTHER_PART = re.compile(r"\b\d{5}\b|,|، |\n|(?:Apt|Flat|Unit|Suite)\b|[0-9０-９][号室호栋]|丁目|〒")


def _address(text: str, start: int, end: int, base: float = 1.0) -> tuple[int, int, str, float]:
    """A street with a house number counts by itself; a further part (town, flat, postal code) or words of place confirm it."""
    near = text[max(0, start - 32): start]
    score = base + 0.3 * bool(_FURTHER_PART.search(text, start, end)) + 0.3 * bool(_PLACE_WORDS.search(near)) - 0.8 * bool(_PART_WORDS.search(near))
    return start, end, "address", score


def _addresses(text: str) -> Iterator[tuple[int, int, str, float]]:
    for p, signs in zip(_ADDRESSES, _SIGNS):
        if not any(sign in text for sign in signs):
            continue
        for m in p.finditer(text):
            yield _address(text, m.start(), m.end() - (len(m.group()) - len(m.group().rstrip())))
    if "号" in text or any(c in text for c in "路街道巷弄"):
        for m in _HAN_ADDRESS.finditer(text):
            yield _address(text, m.start("span"), m.end("span"), 1.3 if m["label"] else 1.0)
    if any(c in text for c in "県都府道"):
        for m in _JA_ADDRESS.finditer(text):
            yield _address(text, m.start("span"), m.end("span"), 1.3 if m["label"] else 1.0)


# --- names --------------------------------------------------------------------------------
class Names:
    """Known given and family names, and the stems and endings that several of them share."""

    def __init__(self, rows: list[tuple[str, str]], shared: int = 4):
        self.known = {k: {n.lower() for n, kind in rows if n and kind == k} for k in ("given", "family")}
        self.parts: dict[str, tuple[set[str], set[str]]] = {}
        for kind, names in self.known.items():
            ends, stems = defaultdict(set), defaultdict(set)
            for n in names:
                if re.fullmatch(r"[^\W\d_]+(?:-[^\W\d_]+)?", n) and n.isascii():
                    for i in range(2, len(n)):
                        ends[n[:i]].add(n[i:])
                        stems[n[i:]].add(n[:i])
            self.parts[kind] = ({s for s, e in ends.items() if len(e) >= shared}, {e for e, s in stems.items() if len(s) >= shared})
        # names in scripts without spaces: family names and given names by themselves
        self.scripts = {}
        for tag, chars in (("han", rf"[{_HAN}{_KANA}]"), ("hangul", "[가-힣]")):
            fam = sorted((n for n in self.known["family"] if re.fullmatch(chars + "+", n)), key=lambda n: (-len(n), n))
            giv = sorted((n for n in self.known["given"] if re.fullmatch(chars + "+", n)), key=lambda n: (-len(n), n))
            self.scripts[tag] = (fam, giv)

    def like(self, word: str, kind: str) -> bool:
        word = word.lower()
        if word in self.known[kind]:
            return True
        stems, ends = self.parts[kind]
        return any(word[:i] in stems and word[i:] in ends for i in range(2, len(word)))


_WORD = r"(?:[A-ZÀ-Þ][a-zà-ÿ]+(?:-[A-ZÀ-Þ][a-zà-ÿ]+)*|[A-ZÀ-Þ]{2,}(?:-[A-ZÀ-Þ]{2,})*)"
_LETTER = "A-Za-z0-9_À-ÿ"
# Titles, and the parts that a person may have in a matter.
_TITLES = ("mr", "ms", "mrs", "miss", "mx", "dr", "prof", "sir", "madam", "rev", "hon")
_PARTS = ("claimant", "plaintiff", "defendant", "applicant", "respondent", "appellant", "petitioner", "witness", "patient", "customer", "client",
          "employee", "tenant", "landlord", "trustee", "director", "manager", "buyer", "seller", "recipient", "sender")
_PAIR = re.compile(
    rf"(?<![{_LETTER}@.\-])(?:(?P<i>[A-Z])\. (?P<if>{_WORD})|(?P<f>{_WORD}), (?P<g>{_WORD})(?: [A-Z]\.)?(?![{_LETTER}\-])|(?P<a>{_WORD})(?: [A-Z]\.)? (?P<b>{_WORD}))(?![{_LETTER}\-@])")
_NOT_AFTER = re.compile(r" (?:Holdings|Ltd|Inc|LLC|GmbH|Group|Company|Co\.|Street|Road|Avenue|Ave|Lane|Rd|St\b|Quay|Institute|University|Foundation|Bank)")
_ROLES = frozenset(_TITLES + _PARTS)
_TITLE = re.compile(
    rf"(?:\b(?:{'|'.join(x.title() for x in _TITLES)})\.? |\b(?i:{'|'.join(_PARTS)}) "
    r"|\b(?:regards|sincerely|yours|thanks|cheers),\s*|\b(?:I'm|I am|my name is|this is) "  # closings, and who speaks
    r"|\b(?i:name|cc|bcc|attn|contact|author|signed)\"?\s?[:=,]\s?\"?|\b(?:[a-z]+ed|written) (?:for )?by |\b(?i:ask|asked) for (?:[DM]rs?\.? |Ms\.? )?"  # labels, and who did it
    r"|氏名[,は：:]|姓名：|성명 |họ tên: |atas nama |والاسم: |\b(?:ông|bà|Ông|Bà|Bapak|Ibu|anh|chị) |السيدة? |คุณ|นาย|นางสาว|นาง|经办人：|联系|担当は|담당자 |원고 )$")
_AFTER = re.compile(r"(?:先生|女士|様|さん|氏|\s?님|\s?씨)")
_DOES = re.compile(r" (?:[a-z]{2,}ed|said|says|wrote|sent|told) ")  # a person does something


def _latin_names(text: str, names: Names) -> Iterator[tuple[int, int, str, float]]:
    at = 0
    while m := _PAIR.search(text, at):
        at = m.start() + 1
        if m["i"]:
            family, given = m["if"], None
        elif m["f"]:
            family, given = m["f"], m["g"]
        else:
            given, family = m["a"], m["b"]
        if given is not None and (given if m["a"] else family).lower() in _ROLES:
            at = m.end("a") if m["a"] else m.end("f")
            continue
        fam = names.like(family, "family")
        giv = given is None or names.like(given, "given")
        score = 0.75 * fam + (0.5 if given is not None and giv else 0.1 if given is None else 0)
        if score < 0.4 and given is not None:  # try from the next word on
            if not _TITLE.search(text[max(0, m.start() - 18): m.start()]):
                at = m.end("f") if m["f"] else m.end("a")
                continue
        left, right = text[max(0, m.start() - 18): m.start()], text[m.end(): m.end() + 18]
        if _TITLE.search(left) or _AFTER.match(right) or not m["f"] and _DOES.match(right):
            score += 0.6
        if _NOT_AFTER.match(right):
            score -= 1.5
        if score >= THRESHOLD:
            yield m.start(), m.end(), "name", score
            at = m.end()


_CHARS = rf"[{_HAN}{_KANA}]"
_HAN_NAME = [
    re.compile(rf"(?:联系|经办人：|姓名：|收件人：|联系人：|申请人：|致)(?P<n>[{_HAN}]{{2,5}}?)(?=先生|女士|小姐|，|,|。|\s|$)"),
    re.compile(rf"(?:^|[\s。，；：、“\"(（])(?P<n>[{_HAN}]{{2,4}})(?=先生|女士|小姐)", re.M),
    re.compile(rf"(?:担当は|氏名[は,：]|名前は|申請者は|^|[\s。、，「])(?P<n>{_CHARS}{{1,4}}[ 　]?{_CHARS}{{1,5}}?)(?=様|さん|氏(?![名])|殿)", re.M),
    re.compile(rf"(?:氏名[は,：]|お名前[：は])(?P<n>{_CHARS}{{1,4}}[ 　]?{_CHARS}{{1,5}}?)(?=[,。、\s]|$)", re.M),
    re.compile(r"(?:^|[\s.,;:\"'(])(?P<n>[가-힣]{2,4})(?= (?:님|씨)(?![가-힣]{2}))", re.M),
    re.compile(r"(?:담당자|성명|이름|원고|피고|신청인|수신인)[:：]? (?P<n>[가-힣]{2,4})(?=[ .,]|$)", re.M),
    re.compile(r"(?:السيدة?|والاسم:|الاسم:|الدكتورة?|الأستاذة?) (?P<n>[ء-ي]{2,12} (?:ال)?[ء-ي]{2,14})(?=[ .،,\n]|$)"),
    re.compile(r"(?<![ก-๎])(?:ติดต่อ)?(?:คุณ|นาย|นางสาว|นาง)(?P<n>[ก-๎]{2,20} [ก-๎]{2,24})(?= (?:ที่|อยู่|โทร)|\s|$)"),
]
_NEAR = re.compile(r"\s?(?:근처|부근|附近|近く)")  # what is near it is a place
_HONOUR_TOO = re.compile(r"先生|女士|様|さん|氏|님|씨|السيد|الاسم|คุณ|นาย|นาง|经办人|姓名|성명|담당자|원고|피고")


def _script_names(text: str, names: Names, lone: list) -> Iterator[tuple[int, int, str, float]]:
    if _HONOUR_TOO.search(text):
        for p in _HAN_NAME:
            for m in p.finditer(text):
                yield m.start("n"), m.end("n"), "name", 1.4
    if text.isascii():
        return
    for script, pattern, before in lone:
        if script.search(text):
            for m in pattern.finditer(text):
                inside = before and m.start() and re.match(f"[{before}]", text[m.start() - 1])
                if not inside and not _NEAR.match(text, m.end()):
                    yield m.start(), m.end(), "name", 1.1


def _lone(names: Names) -> list[tuple[re.Pattern, re.Pattern, str]]:
    """Family name next to given name, both known: (script, names, what may not stand before)."""
    parts = []
    for tag, sep, script, before in (("han", "[ 　]?", f"[{_HAN}]", ""), ("hangul", "", "[가-힣]", "가-힣")):
        fam, giv = names.scripts[tag]
        if fam and giv:
            # in Hangul a place name may begin like a name; only a word of its own counts
            after = "(?![가-힣])" if tag == "hangul" else ""
            body = f"(?:{'|'.join(map(re.escape, fam))}){sep}(?:{'|'.join(map(re.escape, giv))}){after}"
            parts.append((re.compile(script), re.compile(body), before))
    for chars in ("ء-ي", "ก-๎"):
        giv, fam = ([re.escape(n) for n in sorted(names.known[k]) if re.fullmatch(f"[{chars}]+", n)] for k in ("given", "family"))
        if giv and fam:
            parts.append((re.compile(f"[{chars}]"), re.compile(f"(?:{'|'.join(giv)}) (?:{'|'.join(fam)})"), "ء-ي" if chars == "ء-ي" else ""))
    return parts


def find(text: str, names: Names, lone: list) -> list[tuple[int, int, str]]:
    """Non-overlapping (start, end, kind), in order."""
    spans = [*_emails(text), *_numbers(text), *_addresses(text), *_latin_names(text, names), *_script_names(text, names, lone)]
    spans.sort(key=lambda s: (-_RANK[s[2]] if s[2] != "name" else 0, -s[3], s[0], -s[1]))
    taken: list[tuple[int, int, str]] = []  # in order, so that only the two beside a span can overlap it
    for start, end, kind, score in spans:
        if score < THRESHOLD - 0.1:
            continue
        i = bisect.bisect(taken, (start,))
        if (i == 0 or taken[i - 1][1] <= start) and (i == len(taken) or end <= taken[i][0]):
            taken.insert(i, (start, end, kind))
    return taken


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, end, kind in spans:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def _scan(df: DataFrame, id_col: str, text_col: str, known_names: DataFrame, schema: str, rows) -> DataFrame:
    spark = df.sparkSession
    listed = [tuple(r) for r in known_names.select("name", "kind").where("name is not null").distinct().orderBy("name", "kind").limit(200_001).collect()]
    if len(listed) > 200_000:
        raise ValueError("known_names is a reference list of at most 200,000 names")
    held = spark.sparkContext.broadcast(listed)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names(held.value)
        lone = _lone(names)
        for b in batches:
            got = [r for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in rows(i, t, names, lone)]
            if got:
                yield pa.RecordBatch.from_pylist(got, schema=held_schema)

    field = df.select(F.col(id_col).alias("id"))
    id_type = field.schema[0].dataType
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = StructType.fromDDL(schema.replace("ID", id_type.simpleString()))
    held_schema = to_arrow_schema(out)
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(scan, out)


def find_personal_info(df: DataFrame, id_col: str, text_col: str, known_names: DataFrame) -> DataFrame:
    """(id, kind, start_char, end_char, found), one row per piece of personal information."""
    def rows(i, t, names, lone):
        return [{"id": i, "kind": k, "start_char": a, "end_char": b, "found": t[a:b]} for a, b, k in find(t, names, lone)] if t else []

    return _scan(df, id_col, text_col, known_names, "id ID, kind string, start_char int, end_char int, found string", rows)


def redact_personal_info(df: DataFrame, id_col: str, text_col: str, known_names: DataFrame) -> DataFrame:
    """(id, text, n_found): every row, with typed placeholders; null stays null."""
    def rows(i, t, names, lone):
        spans = find(t, names, lone) if t else []
        return [{"id": i, "text": redact(t, spans) if t else t, "n_found": len(spans)}]

    return _scan(df, id_col, text_col, known_names, "id ID, text string, n_found int", rows)
