"""The languages that a profile can name. Fixed values; those with rules are the ones that have a pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.kernel import PACKS

# Code and own name.
LANGUAGES = {
    "af": "Afrikaans", "am": "አማርኛ", "ar": "العربية", "az": "Azərbaycanca", "be": "Беларуская", "bg": "Български",
    "bn": "বাংলা", "bs": "Bosanski", "ca": "Català", "cs": "Čeština", "cy": "Cymraeg", "da": "Dansk",
    "de": "Deutsch", "el": "Ελληνικά", "en": "English", "es": "Español", "et": "Eesti", "eu": "Euskara",
    "fa": "فارسی", "fi": "Suomi", "fr": "Français", "ga": "Gaeilge", "gl": "Galego", "gu": "ગુજરાતી",
    "he": "עברית", "hi": "हिन्दी", "hr": "Hrvatski", "hu": "Magyar", "hy": "Հայերեն", "id": "Bahasa Indonesia",
    "is": "Íslenska", "it": "Italiano", "ja": "日本語", "ka": "ქართული", "kk": "Қазақша", "km": "ខ្មែរ",
    "kn": "ಕನ್ನಡ", "ko": "한국어", "ku": "Kurdî", "ky": "Кыргызча", "lo": "ລາວ", "lt": "Lietuvių",
    "lv": "Latviešu", "mk": "Македонски", "ml": "മലയാളം", "mn": "Монгол", "mr": "मराठी", "ms": "Bahasa Melayu",
    "my": "မြန်မာ", "nb": "Norsk bokmål", "ne": "नेपाली", "nl": "Nederlands", "nn": "Nynorsk", "pa": "ਪੰਜਾਬੀ",
    "pl": "Polski", "ps": "پښتو", "pt": "Português", "ro": "Română", "ru": "Русский", "si": "සිංහල",
    "sk": "Slovenčina", "sl": "Slovenščina", "sq": "Shqip", "sr": "Српски", "sv": "Svenska", "sw": "Kiswahili",
    "ta": "தமிழ்", "te": "తెలుగు", "th": "ไทย", "tl": "Tagalog", "tr": "Türkçe", "uk": "Українська",
    "ur": "اردو", "uz": "Oʻzbekcha", "vi": "Tiếng Việt", "zh": "中文",
}


def languages(spark: SparkSession) -> DataFrame:
    """id, label, has_rules; those with rules first, then by id. A known code without a pack adds nothing to a scan."""
    rows = [(k, v, k in PACKS) for k, v in LANGUAGES.items()]
    return spark.createDataFrame(rows, "id string, label string, has_rules boolean").orderBy("has_rules", "id", ascending=[False, True])
