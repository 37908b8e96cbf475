"""Names and codes of the order-event file.

Every table here holds fixed values: they are the data format, not logic.
"""

from __future__ import annotations

# Raw column of the file -> engine column, by target type.
TEXT_COLUMNS = {
    "EMIR NO": "order_id",
    "ISLEM KODU": "stock",
    "ALIS_SATIS": "side",
    "SEANS": "session",
}
TIME_COLUMNS = {
    "EMIR GIRIS TARIHI": "entry_ts",
    "EMIR DEGISTIRILME TARIHI": "change_ts",
}
NUMBER_COLUMNS = {
    "EMIR MIKTARI": "qty",
    "KALAN MIKTAR": "remaining",
    "GORUNEN MIKTAR": "visible_qty",
    "FIYAT": "price",
}
CODE_COLUMNS = {
    "EMIR DEGISIKLIK SEBEBI": "change_reason",
    "EMIR FIYAT TURU": "order_type",
    "EMIR TURU": "exch_order_type",
    "EMIR KATEGORISI": "order_cat",
}
RAW_COLUMNS = [*TEXT_COLUMNS, *TIME_COLUMNS, *NUMBER_COLUMNS, *CODE_COLUMNS]
ENGINE_COLUMNS = [
    *TEXT_COLUMNS.values(),
    *TIME_COLUMNS.values(),
    *NUMBER_COLUMNS.values(),
    *CODE_COLUMNS.values(),
    "order_tl",
]

# Event codes (change_reason).
CANCELLED_BY_USER = 1
TRADE = 3
REPLACED = 5
NEW = 6
EXPIRED = 19

# Every code that takes an order (or part of it) off the book.
# Expiry (19) and the refresh of a hidden order (13) belong to the family.
CANCEL_CODES = (1, 9, 10, 13, 15, 19, 20, 34, 41, 42, 43, *range(115, 125))

# order_cat of a regular order, order_type of a limit order, sides.
REGULAR_ORDER = 1
LIMIT_ORDER = 1
BUY = "A"
SELL = "S"

# Patterns in the session name, hours of continuous trading.
OPENING_SESSIONS = ("%ACILIS%", "%ACS_EMR%")
CLOSING_SESSIONS = ("%KAPANIS%", "%ESLESTIRMETEKFIYAT%")
CONTINUOUS_FROM_HOUR = 10
CONTINUOUS_TO_HOUR = 18

# Label of each event code.
REASON_NAMES = {
    1: "CANCEL_USER",
    3: "TRADE",
    5: "REPLACED",
    6: "NEW",
    9: "CANCEL_SYS",
    10: "CANCEL_BEHALF",
    13: "ICE_REFRESH",
    15: "CANCEL_LIMIT",
    19: "EXPIRED",
    20: "CANCEL_ISS",
    34: "CANCEL_AUCTION",
    41: "CANCEL_MM_DELTA",
    42: "CANCEL_MM_ABS",
    43: "CROSSING_DEL",
}

# Ticker pattern of an equity.
EQUITY_TICKER = "%.E"
