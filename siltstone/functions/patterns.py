"""Patterns of identifiers in texts, with their categories and confidences."""

from __future__ import annotations

#: Category, name and pattern of the identifier detector; all are taken without case, with ^ and $ at lines.
IDENTIFIERS = [
    ("cryptocurrency", "bitcoin_address", r"\b[13][a-km-zA-HJ-NP-Z1-9]{25,34}\b"),
    ("cryptocurrency", "bitcoin_segwit", r"\bbc1[a-z0-9]{39,59}\b"),
    ("cryptocurrency", "ethereum_address", r"\b0x[a-fA-F0-9]{40}\b"),
    ("cryptocurrency", "monero_address", r"\b4[0-9AB][1-9A-HJ-NP-Za-km-z]{93}\b"),
    ("cryptocurrency", "litecoin_address", r"\b[LM3][a-km-zA-HJ-NP-Z1-9]{26,33}\b"),
    ("cryptocurrency", "dogecoin_address", r"\bD{1}[5-9A-HJ-NP-U]{1}[1-9A-HJ-NP-Za-km-z]{32}\b"),
    ("cryptocurrency", "zcash_address", r"\bt1[a-z0-9]{6,83}\b"),
    ("cryptocurrency", "ripple_address", r"\br[a-zA-Z0-9]{24,34}\b"),
    ("darknet", "onion_v2", r"\b[a-z2-7]{16}\.onion\b"),
    ("darknet", "onion_v3", r"\b[a-z2-7]{56}\.onion\b"),
    ("darknet", "i2p_address", r"\b[a-zA-Z0-9\-~=]{60}\.b32\.i2p\b"),
    ("darknet", "eepsite", r"\b[a-zA-Z0-9\-~=]{520}\.b32\.i2p\b"),
    ("location", "decimal_degrees", r"[-+]?([1-8]?\d(\.\d+)?|90(\.0+)?),\s*[-+]?(180(\.0+)?|((1[0-7]\d)|([1-9]?\d))(\.\d+)?)"),
    ("location", "dms_format", r"\d{1,3}°\d{1,2}'[\d.]+\"[NS],?\s*\d{1,3}°\d{1,2}'[\d.]+\"[EW]"),
    ("location", "mgrs_grid", r"\b\d{1,2}[C-X][A-Z]{2}\d{10}\b"),
    ("location", "plus_codes", r"\b[23456789CFGHJMPQRVWX]{8}\+[23456789CFGHJMPQRVWX]{2,3}\b"),
    ("communication", "email_standard", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("communication", "email_protonmail", r"\b[A-Za-z0-9._%+-]+@protonmail\.(com|ch)\b"),
    ("communication", "telegram_username", r"@[a-zA-Z0-9_]{5,32}\b"),
    ("communication", "discord_id", r"\b\d{17,19}\b"),
    ("communication", "icq_number", r"\bICQ:\s*\d{6,10}\b"),
    ("communication", "jabber_id", r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"),
    ("communication", "skype_username", r"\bskype:\s*[a-zA-Z0-9._-]{6,32}\b"),
    ("hash", "md5_hash", r"\b[a-fA-F0-9]{32}\b"),
    ("hash", "sha1_hash", r"\b[a-fA-F0-9]{40}\b"),
    ("hash", "sha256_hash", r"\b[a-fA-F0-9]{64}\b"),
    ("hash", "sha512_hash", r"\b[a-fA-F0-9]{128}\b"),
    ("hash", "ssdeep_hash", r"\b\d+:[A-Za-z0-9/+]+:[A-Za-z0-9/+]+\b"),
    ("hash", "pgp_fingerprint", r"\b[A-F0-9]{4}(?:\s[A-F0-9]{4}){9}\b"),
    ("network", "ipv4_address", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"),
    ("network", "ipv6_address", r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b"),
    ("network", "mac_address", r"\b[0-9a-fA-F]{2}(?::[0-9a-fA-F]{2}){5}\b"),
    ("network", "domain_name", r"\b[a-zA-Z0-9]([a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?\.([a-zA-Z0-9]([a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?\.)*[a-zA-Z]{2,}\b"),
    ("network", "url_http", r"https?://(?:[-\w.])+(?:[:\d]+)?(?:/(?:[\w/_.])*(?:\?(?:[\w&=%.])*)?(?:#(?:[\w.])*)?)?"),
    ("network", "ftp_url", r"ftp://(?:[-\w.])+(?:[:\d]+)?(?:/(?:[\w/_.])*)?"),
    ("document", "passport_number", r"\b[A-Z]{2}\d{7}\b"),
    ("document", "credit_card", r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|3[0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b"),
    ("document", "ssn", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("document", "phone_intl", r"\+\d{1,3}\s?\d{1,14}"),
    ("document", "iban", r"\b[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7}([A-Z0-9]?){0,16}\b"),
    ("temporal", "timestamp_unix", r"\b15\d{8}\b"),
    ("temporal", "date_iso", r"\b\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})\b"),
    ("temporal", "date_standard", r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"),
    ("encoding", "base64", r"\b[A-Za-z0-9+/]{20,}={0,3}\b"),
    ("encoding", "hex_string", r"\b0x[a-fA-F0-9]{8,}\b"),
    ("encoding", "rot13", r"\b[a-np-zA-NP-Z]{10,}\b"),
]
FLAGS = "(?im)"
#: What every match of a pattern holds, in lower case: texts without it are not searched.
HELD = {
    "bitcoin_segwit": "bc1", "ethereum_address": "0x", "zcash_address": "t1", "onion_v2": ".onion", "onion_v3": ".onion", "i2p_address": ".b32.i2p", "eepsite": ".b32.i2p",
    "decimal_degrees": ",", "dms_format": "°", "plus_codes": "+", "email_standard": "@", "email_protonmail": "@protonmail.", "telegram_username": "@", "icq_number": "icq:",
    "jabber_id": "@", "skype_username": "skype:", "ssdeep_hash": ":", "ipv4_address": ".", "ipv6_address": ":", "mac_address": ":", "domain_name": ".", "url_http": "://",
    "ftp_url": "ftp://", "ssn": "-", "phone_intl": "+", "timestamp_unix": "15", "date_iso": ":", "hex_string": "0x",
}

#: Kind, pattern and confidence of personal data; where two overlap the more confident one stays.
PERSONAL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0.95),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}\b", 0.9),
    ("card", r"\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}\b", 0.9),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b", 0.85),
    ("phone", r"\+?\d{1,3}[ -]?\(?\d{3}\)?[ -]\d{3,4}(?:[ -]?\d{3,4})?\b", 0.8),
    ("ip", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", 0.75),
    ("url", r"https?://[A-Za-z0-9._~/?#&=%:+-]+", 0.6),
    ("host", r"\b[a-z0-9-]+(?:\.[a-z0-9-]+)+\b", 0.5),
    ("number", r"\b\d[\d -]{4,}\d\b", 0.4),
]
