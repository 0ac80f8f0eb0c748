"""Currencies, brands, weights, priors, tiers, penalties and thresholds, as plain tables."""

from __future__ import annotations

# Code, symbols (longest match wins), name, date order, decimals.
CURRENCIES = {
    "INR": (("₹", "Rs.", "Rs", "INR"), "Indian Rupee", "DMY", 2),
    "USD": (("$", "US$", "USD"), "US Dollar", "MDY", 2),
    "EUR": (("€", "EUR"), "Euro", "DMY", 2),
    "GBP": (("£", "GBP"), "Pound Sterling", "DMY", 2),
    "JPY": (("¥", "JPY"), "Japanese Yen", "DMY", 0),
    "CNY": (("CNY", "RMB", "元"), "Chinese Yuan", "DMY", 2),
    "CAD": (("CA$", "C$", "CAD"), "Canadian Dollar", "DMY", 2),
    "AUD": (("A$", "AU$", "AUD"), "Australian Dollar", "DMY", 2),
    "SGD": (("S$", "SGD"), "Singapore Dollar", "DMY", 2),
    "AED": (("AED", "د.إ"), "UAE Dirham", "DMY", 2),
    "CHF": (("CHF", "Fr."), "Swiss Franc", "DMY", 2),
    "ZAR": (("ZAR", "R"), "South African Rand", "DMY", 2),
    "NZD": (("NZ$", "NZD"), "New Zealand Dollar", "DMY", 2),
    "SEK": (("SEK", "kr"), "Swedish Krona", "DMY", 2),
}
SYMBOLS = sorted({s for c in CURRENCIES.values() for s in c[0]}, key=lambda s: (-len(s), s))
# Symbols that several currencies share, most common first.
SHARED_SYMBOLS = {"$": ("USD", "CAD", "AUD", "SGD", "NZD"), "kr": ("SEK",), "R": ("ZAR",)}
# Locale markers and the currency that they hint at, in order.
LOCALE_HINTS = (
    (r"(?i)\b(?:GSTIN|CGST|SGST|IGST)\b", "INR"),
    (r"(?i)\b(?:USt-IdNr|MwSt|Mehrwertsteuer|Rechnung|Gesamtbetrag)\b", "EUR"),
    (r"(?i)\b(?:TVA|Facture|Montant)\b", "EUR"),
    (r"(?i)\b(?:IVA|Importe|Factura)\b", "EUR"),
    (r"(?i)\b(?:EIN|Sales\s*Tax)\b", "USD"),
    (r"(?i)\bVAT\s*(?:Reg(?:istration)?\.?\s*)?(?:No|Number)?\b.{0,4}\bGB", "GBP"),
    (r"\b(?:HST|GST/HST|QST|PST)\b", "CAD"),
)

# Brand, words a vendor entry must contain, contained keys, exact keys.
BRANDS = (
    ("Indian Oil", ("indian", "oil"), ("indianoil", "indianoilcorporation"), ("iocl", "ioc")),
    ("Bharat Petroleum", ("bharat", "petroleum"), ("bharatpetroleum",), ("bpcl",)),
    ("Hindustan Petroleum", ("hindustan", "petroleum"), ("hindustanpetroleum",), ("hpcl", "hp")),
    ("Shell", ("shell",), ("shellselect", "shellindia"), ("shell",)),
    ("Nayara Energy", ("nayara",), ("nayara", "nayaraenergy"), ()),
    ("Jio-bp", ("jio", "bp"), ("jiobp", "reliancebp"), ("jiobp",)),
)
FUZZY_BRAND, VENDOR_SNAP = 84, 88

# Confidence weights by field and component; each row sums to 1.
FIELD_WEIGHTS = {
    "vendor": {"pat": 0.10, "pos": 0.15, "ocr": 0.15, "fuzz": 0.30, "uniq": 0.10, "ml": 0.20},
    "date": {"pat": 0.35, "pos": 0.10, "ocr": 0.10, "fmt": 0.25, "uniq": 0.10, "ml": 0.10},
    "total": {"pat": 0.30, "pos": 0.15, "ocr": 0.10, "arith": 0.30, "uniq": 0.05, "ml": 0.10},
    "subtotal": {"pat": 0.30, "pos": 0.10, "ocr": 0.10, "arith": 0.30, "uniq": 0.10, "ml": 0.10},
    "cgst": {"pat": 0.30, "ocr": 0.10, "arith": 0.20, "uniq": 0.05, "ml": 0.10, "rate": 0.25},
    "sgst": {"pat": 0.30, "ocr": 0.10, "arith": 0.20, "uniq": 0.05, "ml": 0.10, "rate": 0.25},
    "igst": {"pat": 0.30, "ocr": 0.10, "arith": 0.20, "uniq": 0.05, "ml": 0.10, "rate": 0.25},
    "cess": {"pat": 0.35, "ocr": 0.15, "arith": 0.25, "uniq": 0.10, "ml": 0.15},
    "tax_total": {"pat": 0.35, "ocr": 0.15, "arith": 0.25, "uniq": 0.10, "ml": 0.15},
    "round_off": {"pat": 0.50, "ocr": 0.20, "uniq": 0.15, "ml": 0.15},
    "gstin": {"pat": 0.25, "pos": 0.10, "ocr": 0.15, "fmt": 0.50},
    "invoice_no": {"pat": 0.45, "pos": 0.10, "ocr": 0.10, "fmt": 0.20, "uniq": 0.10, "ml": 0.05},
}
# Mean and deviation of a field's place on the page.
POSITION_PRIORS = {
    "vendor": (0.05, 0.18), "date": (0.25, 0.30), "invoice_no": (0.25, 0.30), "gstin": (0.20, 0.25),
    "subtotal": (0.82, 0.15), "cgst": (0.86, 0.12), "sgst": (0.86, 0.12), "igst": (0.86, 0.12),
    "cess": (0.86, 0.12), "tax_total": (0.88, 0.12), "round_off": (0.90, 0.12), "total": (0.93, 0.10),
}
PENALTIES = {"ambiguous_dmy": 0.85, "repaired": 0.80, "cgst_sgst_mismatch": 0.90, "wrapped_value": 0.90, "noisy_scan": 0.95}
VALIDATOR_FAIL_CAP, NEUTRAL_ML, REVIEW_BELOW, AUTO_ACCEPT = 0.35, 0.60, 0.60, 0.8216
GST_RATES = (0.0, 0.125, 1.5, 2.5, 5.0, 6.0, 9.0, 12.0, 14.0, 18.0, 28.0)
TIER_SCORES = {"S1": 1.00, "S2": 0.85, "S3": 0.70, "S4": 0.45, "S5": 0.20}
PATTERN_TIERS = {
    "total.labelled": "S2", "total.amount_label": "S3", "total.positional": "S4", "total.max": "S5",
    "subtotal.labelled": "S2", "subtotal.derived": "S4", "cgst.labelled": "S2", "sgst.labelled": "S2",
    "igst.labelled": "S2", "cess.labelled": "S2", "tax_total.labelled": "S2", "round_off.labelled": "S2",
    "cgst.derived": "S4", "sgst.derived": "S4", "igst.derived": "S4", "gstin.strict": "S1",
    "gstin.labelled": "S2", "gstin.repaired": "S3", "invoice_no.labelled": "S2", "invoice_no.formatted": "S3",
    "invoice_no.bare": "S4", "date.labelled": "S2", "date.bare": "S3", "vendor.gstin_lookup": "S1",
    "vendor.brand": "S2", "vendor.header": "S3", "vendor.fallback": "S4",
}
LINE_ROLES = ("VENDOR", "ADDRESS", "GSTIN", "DATE", "INVOICE", "ITEM", "SUBTOTAL", "TAX", "TOTAL", "FOOTER", "OTHER")

# The role that the line of a field should have.
EXPECTED_ROLES = {
    "vendor": "VENDOR", "date": "DATE", "invoice_no": "INVOICE", "gstin": "GSTIN", "subtotal": "SUBTOTAL", "total": "TOTAL",
    "cgst": "TAX", "sgst": "TAX", "igst": "TAX", "cess": "TAX", "tax_total": "TAX", "round_off": "TAX",
}

# Fixed values of the duplicate engine.
SIGNAL_WEIGHTS = {"invoice": 0.2233, "amount": 0.0827, "vendor": 0.1946, "date": 0.2232, "image": 0.0265, "text": 0.2497}
BANDS = (("EXACT", 0.92), ("HIGH", 0.78), ("MEDIUM", 0.62), ("LOW", 0.45))
BAND_ORDER = ("NONE", "LOW", "MEDIUM", "HIGH", "EXACT")
KEEP_SCORE, CROSS_EMPLOYEE = 0.45, 0.88
WINDOW_DAYS, MAX_BLOCK, MAX_TOKEN_DF, RARE_TOKENS, AMOUNT_BUCKET = 180, 40, 5, 3, 50
TOKEN_STOP_WORDS = ("invoice", "total", "amount", "receipt", "gstin", "date", "bill", "thank", "visit", "again", "customer", "copy", "original", "tax")
MAX_TERMS = 50_000
PHASH_SAME, IMAGE_FLOOR, VENDOR_SAME = 2, 0.90, 90
INVOICE_STOP_WORDS = ("GST", "TAX", "ORIGINAL", "DUPLICATE", "TRIPLICATE", "INVOICE", "RECEIPT", "BILL", "MEMO", "NO", "DATE", "COPY")
# Which characters a scanner confuses.
CONFUSIONS = {
    "0": "OQD", "O": "0", "Q": "0", "D": "0", "1": "IL", "I": "1", "L": "1", "5": "S", "S": "5", "8": "B",
    "B": "8", "2": "Z", "Z": "2", "4": "A", "A": "4", "6": "G", "G": "6", "7": "T", "T": "7",
}
GSTIN_SHAPE = "DDLLLLLDDDDLAZA"
