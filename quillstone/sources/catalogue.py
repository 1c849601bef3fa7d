"""An in-memory catalogue of short prompts: language, category, text and what should come next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "text string, language string, category string, expected_next string, expected_concept string"
LANGUAGE_NAMES = {"en": "English", "ja": "Japanese", "ko": "Korean", "zh": "Chinese", "ar": "Arabic", "de": "German", "fr": "French"}
ENTITIES = ("Harbour Freight Desk", "Northgate Billing", "Quarry Lane Support")
MIXED_SCRIPT = ("見積 quote 견적", "invoice 請求書 №7", "العقد contract 契約")

_OPPOSITE = {
    "en": "The opposite of {} is", "ja": "「{}」の反対は", "ko": "'{}'의 반대말은", "zh": "“{}”的反义词是", "ar": "عكس {} هو",
    "de": "Das Gegenteil von {} ist", "fr": "Le contraire de {} est"}
_ANTONYMS = {
    "heat": {"en": "hot cold", "ja": "熱い 冷たい", "ko": "뜨겁다 차갑다", "zh": "热 冷", "ar": "حار بارد", "de": "heiß kalt", "fr": "chaud froid"},
    "height": {"en": "high low", "ja": "高い 低い", "ko": "높다 낮다", "zh": "高 低", "ar": "عال منخفض", "de": "hoch niedrig", "fr": "haut bas"},
    "speed": {"en": "fast slow", "ja": "速い 遅い", "ko": "빠르다 느리다", "zh": "快 慢", "ar": "سريع بطيء", "de": "schnell langsam", "fr": "rapide lent"},
    "light": {"en": "bright dark", "ja": "明るい 暗い", "ko": "밝다 어둡다", "zh": "亮 暗", "ar": "مضيء مظلم", "de": "hell dunkel", "fr": "clair sombre"},
    "age": {"en": "new old", "ja": "新しい 古い", "ko": "새롭다 낡다", "zh": "新 旧", "ar": "جديد قديم", "de": "neu alt", "fr": "neuf vieux"},
    "weight": {"en": "heavy light", "ja": "重い 軽い", "ko": "무겁다 가볍다", "zh": "重 轻", "ar": "ثقيل خفيف", "de": "schwer leicht", "fr": "lourd léger"}}
_DAYS = {
    "en": ("Monday, Tuesday,", "Wednesday"), "ja": ("月曜日、火曜日、", "水曜日"), "ko": ("월요일, 화요일,", "수요일"), "zh": ("星期一、星期二、", "星期三"),
    "ar": ("الاثنين، الثلاثاء،", "الأربعاء"), "de": ("Montag, Dienstag,", "Mittwoch"), "fr": ("lundi, mardi,", "mercredi")}
_OPEN = {
    "refund": {"en": "A customer asks for a refund. Reply:", "ja": "返金を求める顧客への返信：", "ko": "환불을 요청한 고객에게 답장:", "zh": "回复要求退款的客户：", "ar": "رد على عميل يطلب استرداد المبلغ:", "de": "Antwort an einen Kunden, der sein Geld zurück will:", "fr": "Réponse à un client qui veut être remboursé :"},
    "schedule": {"en": "The meeting moves to Friday. Write a note:", "ja": "会議は金曜に変わりました。連絡文：", "ko": "회의가 금요일로 바뀌었습니다. 알림:", "zh": "会议改到周五。通知：", "ar": "تأجل الاجتماع إلى الجمعة. اكتب إشعارا:", "de": "Die Sitzung ist nun am Freitag. Notiz:", "fr": "La réunion passe à vendredi. Note :"},
    "summary": {"en": "Sum up the contract in one line:", "ja": "契約を一行で要約：", "ko": "계약을 한 줄로 요약:", "zh": "用一行概括合同：", "ar": "لخص العقد في سطر واحد:", "de": "Fasse den Vertrag in einer Zeile zusammen:", "fr": "Résume le contrat en une ligne :"}}


def rows() -> list[tuple]:
    """7 languages x 10 categories."""
    out = []
    for lang in LANGUAGE_NAMES:
        for concept, words in _ANTONYMS.items():
            first, second = words[lang].split(" ")
            out.append((_OPPOSITE[lang].format(first), lang, f"antonym_{concept}", second, concept))
        out.append((_DAYS[lang][0], lang, "sequence_days", _DAYS[lang][1], "days"))
        out += [(texts[lang], lang, f"open_{name}", None, None) for name, texts in _OPEN.items()]
    return out


def prompts(spark: SparkSession, languages: list[str] | None = None, category: str | None = None) -> DataFrame:
    df = spark.createDataFrame(rows(), SCHEMA)
    if languages is not None:
        df = df.where(F.col("language").isin(languages))
    return df if category is None else df.where(F.col("category") == category)
