"""Tokens and patterns of the source documents that results depend on."""

from __future__ import annotations

# Funding tokens and the total token.
FUNDING_TOKENS = ("계", "국비", "지방비", "도비", "시군비", "시비", "기금", "비예산")
TOTAL_TOKEN = "계"

# Row patterns.
SIDO_TITLE = r"붙\s*임\s*\(([^)]+)\)"
MAJOR_HEAD = r"^[Ⅰ-Ⅿ]"
MEDIUM_HEAD = r"^\d+\."
BUDGET_TYPE_SUFFIX = r"\((공통|자체)(사업)?\)$|(공통|자체)사업$|\((도|시군)\)$"
MEDIUM_WITH_TYPE = r"^\d+[-\d]*\.\s*(.+?)\s*\((공통사업|자체사업)\)$"
BRACKET_MARK = r"^\[\s*(공\s*통|자\s*체)\s*사\s*업\s*\]"
LEADING_BULLET = r"^\s*[ㅇ○◦□▪·•o\-]\s*"
PRIVATE_USE = r"[\uE000-\uF8FF]"
NAME_HEADER = "세부사업명"

# Labels and list marks of body texts.
CONTENT_LABELS = ("지원대상", "지원내용", "사업대상", "사업내용", "주요내용", "전달체계", "목적", "대상", "내용")
REPEATED_LABELS = ("지원대상", "지원내용", "사업대상", "사업내용")
BULLET = r"[ㅇ○◦□▪•]|(?<![0-9A-Za-z가-힣])·"
STRICT_LABELS = r"(?s)^지원대상\s*[:：]\s*(.*?)\s*지원내용\s*[:：]\s*(.*)$"
BROAD_LABELS = r"(?s)^(지원대상|사업대상|대상)\s*[:：]?\s*(.*?)\s*(지원내용|사업내용|내용)\s*[:：]?\s*(.*)$"
MATCH_DROPPED = r"[\s,./\-()]"

# Numbers, quantities and names that a rewrite must keep.
NUMBER = r"(\d+)"
QUANTITY = r"([+-]?\d[\d,]*(?:\.\d+)?(?:\s*(?:~|∼|～|-|–|—)\s*[+-]?\d[\d,]*(?:\.\d+)?)?\s*(?:%|퍼센트|백만\s*원|천\s*원|만\s*원|억\s*원|조\s*원|원|명|가구|세대|개소|개|회|개월|년|월|일|세)?)"
QUOTED = r"[「『\"“‘]([^」』\"”’]{2,})[」』\"”’]"
NAME_TOKEN = r"([가-힣A-Za-z0-9·]+(?:특별자치도|특별자치시|특별시|광역시|도청|시청|군청|구청|위원회|복지관|보건소|대학교|대학|학교|병원|의원|재단|공단|공사|협회|센터|연구원))"
SOURCE_LABEL = r"(?:^|\s)원문\s*[:：]"
