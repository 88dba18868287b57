"""Patterns and character ranges that results depend on, in Java's syntax."""

ORDERED = r"^(?U)\s*(?:(?:\d+[.．、)](?!\d))|(?:[（(]\s*\d+\s*[)）])|(?:[①-⑳]))\s*(.+)$"
BULLET = r"^(?U)\s*[•·●▪◦]\s*(.+)$"
PLUGIN = r"^(?U)\s*(plugin_[a-zA-Z0-9_]+)\s*[:：]\s*(.+)$"
SECTION = r"^(?U)\s*(?:[一二三四五六七八九十百]+、|摘要(?:\s|$)|参考文献(?:\s|（|\(|$))"
SUBSECTION = r"^(?U)\s*\d+\.\d+(?:\s|$)"
NUMERIC_SECTION = r"^(?U)\s*\d+\.(?!\d)\s+\S+"
FORMULA_WORD = r"^(?iU)\s*(?:max|min|s\.\s*t\.)(?:\s|$)"
FORMULA_SYMBOL = r"^(?U)\s*[∑∏∫√∞∂∇∀∃]+"
FORMULA_START = r"^(?U)\s*(?:[A-Za-zα-ωΑ-Ω]|\d)"
LEADING_DOT = r"^(?U)\s*\.\s+"
TERMINAL = r"[。！？!?；;：:.]$"
COLON = r"[：:]$"
URL = r"(?i)https?://\S+"
TAG = r"<[^>]+>"
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
GARBLED = r"[\x{2E80}-\x{2FFF}\x{0B00}-\x{0D7F}\x{1200}-\x{137F}\x{1D400}-\x{1D7FF}\x{FB00}-\x{FB06}\x{FFFD}]"
SUSPICIOUS = r"[\x{FFFD}\x00\p{Co}]"
UNSAFE_NAME = r"(?U)[^\w.\-一-龥]"
#: Glyphs that some fonts put in place of others.
GLYPHS = {"\u0b35": "₁", "\u0b36": "₂", "\u1250": "⎧", "\uf0b7": "•"}
