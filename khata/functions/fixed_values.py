"""Look-up tables, word lists and patterns.

Everything in this module is a value that results depend on, stated as plain text in the order in
which it is tried.  Patterns are written in ECMAScript notation (ASCII ``\\b``, ``\\w``, ``\\d``;
``\\s`` with the Unicode spaces) and are turned into Java patterns by ``text.java``.
No logic lives here.
"""

# --- fixed values: ledger vocabulary -------------------------------------------------------------
CATEGORIES = (
    "food", "groceries", "transport", "shopping", "bills", "entertainment",
    "health", "education", "travel", "transfer", "investment", "income", "other",
)
KINDS = ("expense", "income", "refund", "transfer")
CATEGORY_SOURCES = ("user", "rule", "sender", "model", "llm", "guess", "fallback", "unresolved")
MATERIAL_FIELDS = ("amount", "kind", "category", "merchant", "date_ms", "currency")
CSV_COLUMNS = (
    "date", "kind", "direction", "amount", "currency", "merchant", "category", "categorySource",
    "channel", "account", "bank", "ref", "confidence", "needsReview",
)
REVIEW_THRESHOLD_PCT = 60
SOFT_KEY_BUCKET_MS = 600_000
DRIFT_BODY_CHARS = 160
PAIR_WINDOW_MS = 86_400_000
GUESS_REASON = "paid to what looks like a person — spend or transfer?"
CUSTOM_CATEGORY_NAME = r"^[a-z][a-z0-9 &-]{1,23}$"

# --- fixed values: sender headers ----------------------------------------------------------------
BANK_IDS = {
    "HDFCBK": "HDFC", "HDFCBN": "HDFC", "ICICIB": "ICICI", "ICICIT": "ICICI", "SBIINB": "SBI",
    "SBIUPI": "SBI", "ATMSBI": "SBI", "AXISBK": "Axis", "AXISB": "Axis", "KOTAKB": "Kotak",
    "INDUSB": "IndusInd", "IDFCFB": "IDFC First", "YESBNK": "Yes", "PNBSMS": "PNB",
    "CANBNK": "Canara", "BOIIND": "BOI", "UNIONB": "Union", "FEDBNK": "Federal",
    "RBLBNK": "RBL", "AMEXIN": "Amex", "SCBANK": "StanChart", "CITIBK": "Citi",
    "PAYTMB": "Paytm", "PAYTM": "Paytm", "PHONPE": "PhonePe", "GPAYIN": "GPay",
    "AMZNPY": "Amazon Pay", "CREDCL": "CRED", "SLICEIT": "Slice",
}
SENDER_BRANDS = {
    "EPFOHO": "epfo", "EPFOIN": "epfo",
    "TSSPDC": "tsspdcl", "APSPDC": "apspdcl", "BESCOM": "bescom",
    "REDBUS": "redbus", "IRCTCI": "irctc", "MMYTRP": "makemytrip",
    "MYNTRA": "myntra", "AJIOIN": "ajio", "FKRTIN": "flipkart", "AMAZON": "amazon",
    "SWIGGY": "swiggy", "ZOMATO": "zomato", "BLNKIT": "blinkit", "ZEPTONW": "zepto",
    "ICICIP": "icici prudential", "HDFCLIFE": "hdfc life", "LICIND": "lic",
    "JIOPAY": "jio", "AIRTEL": "airtel", "VODAFN": "vi",
    "ACTFBR": "act fibernet", "BSNLIN": "bsnl",
}
OPERATOR_PREFIX = r"^[A-Z]{2}[-\s]"
BRAND_HEADER = r"^[A-Z][A-Z0-9]{2,9}$"
FINANCIAL_HEADER = r"(BK|BNK|BANK|UPI|PAY|CARD|FIN|CRED)"

# --- fixed values: message rejection -------------------------------------------------------------
STUCK_VERBS = r"(\d)(debited|credited|spent|withdrawn|paid|received|deducted)\b"
REJECT_FIRST = (
    ("otp", r"\b(otp|one[\s-]?time\s*(password|pin)|verification code|do not share)\b"),
    ("promo", r"\b(offer|cashback up to|congratulations|win |sale |discount|apply now|click here|t&c apply|unsubscribe|limited period)\b"),
    ("balance", r"^(?=.*\b(avl|available|closing|a\/c)\s*(bal|balance)\b)(?!.*\b(debited|credited|spent|withdrawn|paid|received|sent|for using)\b)"),
    ("limit", r"^(?=.*\b(credit limit|available limit)\b)(?!.*\b(spent|debited|withdrawn|paid|purchase)\b)"),
    ("hold", r"\b(hold (placed|amount)|pre-?auth|blocked (for|on)|authorization hold|temporarily blocked)\b"),
    ("emandate", r"\b(e-?mandate|standing instruction).*\b(registered|created|cancelled)\b"),
    ("mandate", r"^(?=.*\b(mandate|autopay|standing instruction)\b)(?=.*\b(set|cancelled|registration|registered|created|failed|revoked)\b)(?!.*\bsent\b)"),
    ("payee", r"\b(payee|beneficiary)\b.*\b(added|registered|activated)\b|\badded .{0,30}as a payee\b|\bafter 30 ?min|\bsince adding\b"),
    ("balance", r"\bbal(ance)? in .{0,40}a\/c\b.*\b(gone below|minimum limit)\b|\bmaintain rs\.?\s*[\d,]+ to avoid\b"),
    ("notice", r"\b(scheduled maintenance|will be unavailable|services (will be )?offline|re-?kyc|ckyc|has been (reactivated|generated)|logged into your|pin has been|address updation|e-?mail id verification|convert your .{0,30}into easy emis|smartemi|invites you|beware of|stay safe|fake|smishing|phishing|delink|reward points|hearty points|payback points|voucher|cashback\b.{0,20}\b(valid|earned)|download the app|visit (now|our)|t&cs?\b.{0,10}$)"),
    ("status", r"\b(delivered|dispatched|received by|application|statement (generated|is ready)|e-?statement|unable to confirm|has moved to a new link)\b"),
    ("request", r"\b(is requesting|payment request|collect request|has requested (money|payment)|approve.*request|requested payment (of|for))\b"),
    ("returned", r"\b(returned on|has been unsuccessful|will be reversed|payment attempt .{0,20}unsuccessful)\b"),
    ("failed", r"\b(is declined|was declined|declined!|purchase declined|has failed|payment .{0,30}has failed|low funds|due to low funds|incorrect pin|txn .{0,20}declined)\b"),
)
REJECT_UNLESS_REFUND = (
    ("failed", r"\b(failed|declined|unsuccessful|could not be processed|reversed due to|insufficient)\b"),
    ("reminder", r"\b(due on|payment due|minimum amount due|total amount due|bill generated|statement is ready|autopay.*scheduled|will be debited)\b"),
)
EXPECTED_NOISE = (
    "otp", "promo", "request", "reminder", "balance", "limit", "emandate", "hold",
    "mandate", "payee", "notice", "status", "returned", "failed",
)
UNRECOGNISED_SUBTYPES = ("bank-other", "other")

# --- fixed values: field patterns of a transaction message ---------------------------------------
DEBIT = r"\b(debited|spent|withdrawn|paid|purchase|deducted|sent|transferred to|txn of|charged|processed payment of|payment of|done for|recharged with|loaded with|thanks? (you )?for using)\b"
CREDIT = r"\b(credited|received|deposited|refund(ed)?|revers(al|ed)|cashback of|added to)\b"
REFUND = r"\b(refund(ed)?|reversal|reversed|returned to (your )?(a\/c|account|card)|credited back|charge ?back)\b"
FUTURE = r"\b(will be|shall be|to be)\s+(reversed|credited|refunded)\b"
INTERNAL = "|".join((
    r"\bcredit card (bill|payment|due)\b",
    r"\btowards .{0,20}\bcard\b",
    r"\bcard (bill )?payment\b",
    r"\bpayment (received )?(towards|for) .{0,20}\bcard\b",
    r"\bcard ending .{0,10}\b(paid|payment)\b",
    r"\bself[- ]transfer\b",
    r"\bto your own (a\/c|account)\b",
    r"\b(wallet|paytm|phonepe|amazon pay) (top[- ]?up|add(ed)? money|load)\b",
    r"\badded to your .{0,20}wallet\b",
    r"\bcred\b.{0,30}\bcard\b",
    r"\btowards\b.{0,40}\bcredit card\b",
    r"\bauto ?debit\b.{0,40}\bcredit card\b",
    r"\bcredit card\b.{0,30}\bthrough auto ?debit\b",
    r"\bfastag\b",
    r"\b(epf|epfo|provident fund|ppf|nps)\b.{0,30}\bcontribution\b",
    r"\bcontribution\b.{0,30}\b(epf|epfo|provident fund|ppf|nps|uan)\b",
    r"\bnetc\b",
    r"\bmetro (card|smart ?card)\b.{0,20}\b(recharg|top ?up|load)",
    r"\b(wallet|prepaid (card|instrument))\b.{0,24}\b(recharg|top ?up|load|credit)",
    r"\b(recharg\w*|top ?up|loaded)\b.{0,24}\b(wallet|fastag|netc)\b",
    r"\btransferred to your\b",
    r"\bby transfer from a\/c\b",
    r"\bto your (own )?(a\/c|account|wallet)\b",
))
RUPEE = r"(?:inr|rs\.?|₹|rupees)"
NUMBER = r"(?:\d{1,3}(?:,\d{2,3})+|\d+)(?:\.\d{1,2})?"
# captured: the number with what may stand between it and the currency, or with its sign
AMOUNT_FORMS = (
    rf"{RUPEE}\s*([:\-]?\s*{NUMBER})",
    rf"([-−]?{NUMBER})\s*{RUPEE}",
    rf"\bdebited\s+by\s+({NUMBER})",
    rf"\bcredited\s+by\s+({NUMBER})",
)
FOREIGN = r"\b(USD|EUR|GBP|AED|SGD|AUD|CAD|JPY|CHF|THB|MYR)\s*([\d,]+(?:\.\d{1,2})?)"
ACCOUNT_FORMS = (
    r"\b(?:a\/c|acct|account|ac)\s*(?:no\.?)?\s*[:.]?\s*(?:x+|\*+)?(\d{3,6})\b",
    r"\bcard\s*(?:no\.?)?\s*[:.]?\s*(?:x+|\*+)?(\d{3,6})\b",
    r"\b(?:x{2,}|\*{2,})(\d{3,6})\b",
)
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
DATE_DAY_MONTHNAME = r"\b(\d{1,2})[\s\-\/]?([a-z]{3})[a-z]*[\s\-\/]?(\d{2,4})\b"
DATE_DAY_MONTH = r"\b(\d{1,2})[\-\/](\d{1,2})[\-\/](\d{2,4})\b"
DATE_MONTHNAME_DAY = r"\b([a-z]{3})[a-z]*\s+(\d{1,2}),?\s+(\d{4})\b"
DATE_ISO = r"\b(\d{4})-(\d{2})-(\d{2})\b"
DATE_STATED = r"\b\d{1,2}[\s\-\/]?[a-z]{3}|\b\d{1,2}[\-\/]\d{1,2}[\-\/]\d{2,4}|\b\d{4}-\d{2}-\d{2}"
REFERENCE = r"\b(?:ref(?:erence)?(?:\s*(?:no|num|id))?|rrn|utr|txn(?:\s*id)?|upi(?:\s*ref)?)\s*[:.\-]?\s*(\w{6,25})\b"
MERCHANT_FORMS = (
    r"\bto\s+vpa\s+([^\s;,.]+)",
    r"\bvpa\s+([^\s;,.]+)",
    r"\bTo\s+([^\n]{2,40}?)\s+\d{1,2}[\/\-]\d{1,2}[\/\-]\d{2,4}\b",
    r"\bTo\s+([^\n]{2,40}?)\s+On\s+\d{1,2}[\/\-]",
    r"\bto\s+Merchant\s+([^,;.]{2,40})",
    r"\bdone for\s+([^,;.]{2,40}?)(?:\.{2,}|\s+has\b|[,;.]|$)",
    r"\btrf\s+to\s+([^;,.]+?)(?=\s+(?:ref|refno|on|upi|rrn)\b|[;,.]|$)",
    r"\bat\s+([A-Z0-9][^;,.]{2,40}?)(?=\s+on\b|\s+ref\b|[;,.]|$)",
    r"\bto\s+([A-Z0-9][^;,.]{2,40}?)(?=\s+on\b|\s+ref\b|\s+upi\b|[;,.]|$)",
    r"\bUPI\/(?:P2M|P2A)\/\d+\/([^\/;,.]+)",
    r"\bfrom\s+([A-Z0-9][^;,.]{2,40}?)(?=\s+on\b|\s+ref\b|[;,.]|$)",
    r";\s*([A-Z][A-Za-z0-9 &.\-]{2,40}?)\s+credited",
)
MERCHANT_NOISE = r"\b(a\/c|acct|account|your|the|bank|via|using|ltd|limited|pvt|private|upi|vpa|neft|imps|rtgs|txn|ref)\b"
AGGREGATOR = r"^(razorpay|payu|billdesk|ccavenue|cashfree|instamojo|paytm|phonepe|gpay|bharatpe|pine ?labs|worldline|atom|easebuzz)[\s*|:\-]+"
TRAILING_DATE = r"\s+\d{1,2}[\/\-]\d{1,2}[\/\-]\d{2,4}\s*$"
TRAILING_LABEL = r"\s+(?:on|ref|refno|upi|rrn)\b.*$"
CHANNEL_FORMS = (
    ("upi", r"\bupi\b|\bvpa\b|@[a-z]{2,}"),
    ("card", r"\bcard\b|\bpos\b|\bspent on\b"),
    ("neft", r"\bneft\b"),
    ("imps", r"\bimps\b"),
    ("rtgs", r"\brtgs\b"),
    ("atm", r"\batm\b|\bwithdrawn\b"),
    ("cheque", r"\bcheque|chq\b"),
)
BALANCE = rf"(?:avl|available|closing|updated)?\s*bal(?:ance)?\s*[:.\-]?\s*(?:is\s*)?{RUPEE}?\s*({NUMBER})"

# --- fixed values: merchant categories -----------------------------------------------------------
MERCHANT_RULES = (
    ("food", r"swiggy|zomato|dominos|mcdonald|kfc|pizza|restaurant|cafe|starbucks|eatfit|faasos|behrouz"),
    ("groceries", r"bigbasket|blinkit|zepto|instamart|dmart|grofers|bazaar|kirana|supermarket|reliance fresh|more retail"),
    ("transport", r"uber|ola|rapido|irctc|redbus|metro|petrol|fuel|hpcl|bpcl|iocl|indian oil|shell|parking|fastag"),
    ("shopping", r"amazon|flipkart|myntra|ajio|meesho|nykaa|tatacliq|snapdeal|lenskart|decathlon"),
    ("bills", r"airtel|jio|vodafone|vi |bsnl|electricity|water|gas|broadband|dth|tata power|adani|bescom|torrent power|recharge|postpaid|prepaid"),
    ("entertainment", r"netflix|spotify|hotstar|prime video|sonyliv|zee5|bookmyshow|pvr|inox|youtube|gaming|google play|play store|app ?store|itunes|apple\.com"),
    ("health", r"pharmacy|apollo|medplus|1mg|pharmeasy|hospital|clinic|diagnostics?\b|path\s?lab|labs\b|practo|doctor|medical"),
    ("education", r"school|college|university|tuition|byju|unacademy|vedantu|coursera|udemy|fees"),
    ("travel", r"makemytrip|goibibo|cleartrip|yatra|airbnb|oyo|indigo|vistara|air india|spicejet|hotel|booking\.com"),
    ("investment", r"zerodha|groww|upstox|kuvera|coin|mutual fund|sip |nps |ppf|rd |fd |smallcase|angel one"),
    ("income", r"salary|payroll|interest credit|dividend|refund"),
    ("transfer", r"self|own account|transfer to|neft|imps|rtgs"),
)
COMPANY_WORD = r"\b(ltd|limited|pvt|private|inc|llp|corp|company|store|stores|enterprises|technologies|services|solutions|bank|traders|agencies|mart|hospital|hotel)\b"
PERSON_WORD = r"^(?:[A-Z][a-z]*|[A-Z]{2,})$"

# --- fixed values: inbox classification ----------------------------------------------------------
SPAM = (
    r"\b(earn|income)\s+(rs\.?|₹)?\s*[\d,]+\s*(per day|daily|\/day|per month)\b",
    r"\bwork from home\b.{0,40}\b(earn|income|salary)\b",
    r"\b(lottery|jackpot|lucky draw|you have won|prize money)\b",
    r"\b(loan approved|instant loan).{0,40}\b(no documents|without documents)\b",
    r"\bwa\.me\/\d+",
    r"\btrade summary\b.{0,40}\bagents\b",
)
OTP = r"\b(otp|one[\s-]?time\s*(password|pin)|verification code|do not share)\b"
BILL = (
    r"\b(bill|payment|amount|emi|premium)\s+(is\s+)?due\b",
    r"\b(total|minimum|min)\s+(amount\s+)?due\b",
    r"\bdue\s+(date|on|by)\b",
    r"\b(statement|e-?statement)\s+generated\b",
    r"\bis overdue\b|\bpayment is overdue\b|\bpay immediately\b",
    r"\bplease (make )?pay\b|\bpay your\b.{0,30}\b(bill|dues|card)\b",
    r"\bwill be (debited|deducted)\b",
    r"\balternate pymt\b|\bmake alternate payment\b",
)
TRAVEL = r"\b(pnr|boarding|flight|train|bus|coach|seat no|departure|arrival|gate no|terminal)\b"
DELIVERY = r"\b(delivered|out for delivery|shipped|dispatched|courier|awb|tracking|order .{0,20}(placed|confirmed)|will arrive)\b"
APPOINTMENT = r"\b(appointment|scheduled for|your slot|booking confirmed|reporting time)\b"
SERVICE = (
    r"\b(scheduled maintenance|will be unavailable|services (will be )?offline)\b",
    r"\b(re-?kyc|ckyc|address updation|pin has been|has been (reactivated|generated))\b",
    r"\b(logged into your|login alert|beware of|fraud|smishing|phishing|never asks)\b",
    r"\b(payee|beneficiary)\b.{0,30}\b(added|registered)\b",
    r"\bmandate\b.{0,30}\b(set|cancelled|registered|failed)\b",
    r"\bbal(ance)? in\b.{0,40}\b(gone below|minimum limit)\b",
    r"\b(is dormant|account is inactive|wallet is inactive|reactivate|dormant account)\b",
    r"\b(low balance alert|avl\.? bal|please recharge|reload:|add money immediately)\b",
    r"\bfastag\b",
    r"\b(autopay|e-?mandate|standing instruction)\b.{0,40}\b(active|failed|unable|registered|created|cancelled|revoked)\b",
    r"\bunable to (auto ?pay|process autopay|debit)\b",
    r"^declined\b|\b(declined|has been declined|could not be processed|transaction failed)\b",
    r"\b(card usage limits|usage settings|contactless (facility|usage)|enable at mycards|international transactions)\b",
    r"\b(limit is rs|transaction limit|withdraw cash up to)\b",
    r"\b(trai|rbi guidelines|npci guidelines|as per (rbi|npci|trai)|official and legitimate)\b",
    r"\b(card delivery|out for delivery|is scheduled|awb)\b",
)
PROMOTION = (
    r"\b(offer|sale|discount|cashback up to|flat \d+%|save up to|limited period|hurry|last chance)\b",
    r"\bt&cs?\b|\bterms (and conditions )?apply\b",
    r"\b(download the app|install now|click here|apply now|shop now|book now|order now)\b",
    r"\bconvert\b.{0,80}\binto easy emis?\b|\bsmartemi\b|\bpre-?approved\b|\bupgrade your\b",
    r"\b(reward points|hearty points|payback points|voucher|coupon)\b",
    r"\b(invites you|introducing|new feature|now available)\b",
)
NUMERIC_SENDER = r"^\+?\d{7,15}$"

# --- fixed values: bills -------------------------------------------------------------------------
# captured: day, month (name or number), year
DUE_DATE_FORMS = (
    r"\bdue\s*(?:date)?\s*[:\-]?\s*(\d{1,2})[\s\-\/]?([a-z]{3})[a-z]*[\s\-\/]?(\d{2,4})",
    r"\bdue\s*(?:date)?\s*[:\-]?\s*(\d{1,2})[\-\/](\d{1,2})[\-\/](\d{2,4})",
    r"\bdue\s+(?:on|by)\s+(\d{1,2})[\s\-\/]?([a-z]{3})[a-z]*[\s\-\/]?(\d{2,4})",
    r"\bdue\s+(?:on|by)\s+(\d{1,2})[\-\/](\d{1,2})[\-\/](\d{2,4})",
    r"\bpay\s+by\s+(\d{1,2})[\s\-\/]?([a-z]{3})[a-z]*[\s\-\/]?(\d{2,4})",
    r"\b(?:on|before)\s+(\d{1,2})[\-\/](\d{1,2})[\-\/](\d{2,4})\b(?=[^.]{0,40}\bdue\b)",
)
MINIMUM_DUE = r"\b(?:min(?:imum)?\s+(?:amount\s+)?due)\s*[:\-]?\s*(?:INR|Rs\.?|₹)\s*([\d,]+(?:\.\d{1,2})?)"
DUE_AMOUNT_FORMS = (
    r"\b(?:total\s+(?:amount\s+)?due|amount\s+due|total\s+due)\s*[:\-]?\s*(?:INR|Rs\.?|₹)\s*([\d,]+(?:\.\d{1,2})?)",
    r"\b(?:bill|payment|emi|premium)\s+of\s+(?:INR|Rs\.?|₹)\s*([\d,]+(?:\.\d{1,2})?)",
    r"\b(?:pay|paying)\s+(?:INR|Rs\.?|₹)\s*([\d,]+(?:\.\d{1,2})?)",
    r"(?<!min\s)(?<!minimum\s)(?<!min\sdue\s)(?:INR|Rs\.?|₹)\s*([\d,]+(?:\.\d{1,2})?)\s+(?:is\s+)?due\b",
)
TOTAL_WORDING = r"total|amount\s+due"
BILL_ISSUER = r"\b(?:your|for)\s+([A-Z][A-Za-z ]{2,24}?)\s+(?:bill|card|connection|postpaid)"
BILL_KINDS = (
    ("credit-card", r"\bcredit card\b"),
    ("telecom", r"\b(postpaid|prepaid|mobile|broadband|dth|fibernet)\b"),
    ("utility", r"\b(electricity|power|water|gas|tsspdcl|bescom)\b"),
    ("loan", r"\b(emi|loan)\b"),
    ("insurance", r"\b(premium|insurance|policy)\b"),
)
OVERDUE = r"\b(overdue|immediately|returned on|alternate pymt)\b"

# --- fixed values: learned classifier ------------------------------------------------------------
NB_MIN_EXAMPLES = 12
NB_MIN_PER_CLASS = 3
NB_MIN_MARGIN = 2.0
PRIOR_MIN_EXAMPLES = 4
PRIOR_MIN_SHARE = 0.9
MAGNITUDES = (("xs", 100), ("s", 500), ("m", 2000), ("l", 10000))
MAGNITUDE_TOP = "xl"

# --- fixed values: redaction ---------------------------------------------------------------------
EMAIL = r"\b[\w.+-]+@[\w-]+\.[\w.]{2,}\b"
PAN = r"\b[A-Z]{5}\d{4}[A-Z]\b"
IFSC = r"\b[A-Z]{4}0[A-Z0-9]{6}\b"
PSP_SESSION = "ybl|okicici|okhdfcbank|oksbi|okaxis|paytm|apl|ibl|axl|upi|hdfcbank|icici|sbi|axisbank|axisb|jupiteraxis|fam|superyes"
PSP_OFFLINE = "ybl|okicici|okhdfcbank|oksbi|okaxis|paytm|apl|ibl|axl|upi|hdfcbank|icici|sbi|axisbank"
PHONE_HANDLE = r"^\+?\d{10,13}$"
TOP_DOMAINS_SESSION = "io|in|com|co|me|bank|org|net"
TOP_DOMAINS_OFFLINE = "io|in|com|co|me|bank"
# patterns and placeholders of the passes, in their order
EMAIL_MASK, PAN_MASK, AADHAAR_MASK, IFSC_MASK = "EMAIL_REDACTED", "PANXXXXXXXXX", "AADHAAR_REDACTED", "IFSC0XXXXXX"
AADHAAR_SPACED = r"\b\d{4}[\s-]\d{4}[\s-]\d{4}\b"
AADHAAR_LABELLED = r"\b(aadhaar|uidai)\b([^\d\n]{0,20})(\d{8,12})"
AADHAAR_OFFLINE = r"\b\d{4}\s?\d{4}\s?\d{4}\b"
CARD = r"\b\d{13,19}\b"
VPA = r"\b([A-Za-z0-9._-]{2,})@(PSP)\b"  # PSP stands for the provider names above
OTP_AFTER = r"\b(otp|o\.t\.p|one[\s-]?time\s*(?:password|pin|code)|verification code|security code|passcode|pin)\b([^\d\n]{0,24}?)(\d{4,8})\b"
OTP_BEFORE = r"\b(\d{4,8})(\s+is\s+your\s+(?:otp|one[\s-]?time|verification))"
HELPLINE = r"\b1800[-\s]?\d{3,8}\b"
HELPLINE_18 = r"\b18[0-9]{2}[-\s]?\d{6,8}\b"
HELPLINE_OFFLINE = r"\b1800[\-\s]?\d{3,8}\b"
HELPLINE_MASK = "1800XXXXXX"
PHONE_91 = r"(?<!\d)\+?91[-\s]?[6-9]\d{9}(?!\d)"
PHONE_91_MASK = "919999999999"
PHONE_LANDLINE = r"(?<!\d)0\d{2,4}[-\s]*\d{6,8}(?!\d)"
PHONE_LANDLINE_MASK = "0XXXXXXXXXX"
PHONE = r"(?<!\d)(?:\+91[-\s]?)?[6-9]\d{9}(?!\d)"
PHONE_OFFLINE = r"(?<!\d)(?:\+91[\-\s]?)?[6-9]\d{9}(?!\d)"
PHONE_MASK = "9999999999"
SHORTCODE = r"\b(to|on|at)\s+(\d{5,8})(?!\d)"
# an account word, its optional "no", the mask and the digits
ACCOUNT_SESSION = r"\b(a\/c|acct|account|ac|card|acc)(\s*no\.?)?\s*[:.]?\s*((?:x|\*){0,4})(\d{3,6})\b"
ACCOUNT_OFFLINE = r"\b(a\/c|acct|account|ac|card|acc)\s*(no\.?)?\s*[:.]?\s*((?:x|\*){0,4})(\d{3,6})\b"
MASKED_TAIL = r"\b((?:x|\*){1,4})(\d{4,6})\b"
REFERENCE_ID = r"\b(ref(?:no|erence)?|rrn|utr|txn(?:\s*id)?|transaction no\.?|umn|sr|awb|order id|application)\s*[:.\-]?\s*([A-Za-z0-9_@-]{4,40})"
APPLICATION_ID = r"\b(?:IHL|MHL|SR)[_A-Z0-9]{6,}\b"
APPLICATION_ID_MASK = "APPLICATION_ID"
LONG_ID = r"(?<![\dX*x])\d{7,}(?![\d])"
LONG_MASKED_TAIL = r"\b([Xx*]{4,})(\d{2,6})\b"
# what a text with a hit must have, found without look-around
EMAIL_NEEDS, PAN_NEEDS = r"@[\w-]+\.[\w.]{2}", r"[A-Z]\d{4}[A-Z]"
AADHAAR_SPACED_NEEDS, LONG_MASKED_TAIL_NEEDS = r"\d{4}[\s-]\d{4}[\s-]\d{4}", r"[Xx*]{4}"
AMOUNT_BEFORE_NEEDS, DATE_LEADING_NEEDS = r"[\d,]\s*(?:INR|Rs|₹)", r"\d,?\s+\d{4}"
URL = r"https?:\/\/\S+"
URL_MASK = "https://REDACTED.LINK/x"
SHORT_URL = r"\b(?:[a-z0-9-]+\.)+(?:DOMAINS)\b(?:\/\S*)?"  # DOMAINS stands for the top domains above
SHORT_URL_MASK = "REDACTED.LINK/x"
AMOUNT_AFTER = r"((?:INR|Rs\.?|₹)\s*)([\d,]+(?:\.\d{1,2})?)"
AMOUNT_BEFORE = r"([\d,]+(?:\.\d{1,2})?)(\s*(?:INR|Rs\.?|₹))"
DATE_NUMERIC = r"\b(\d{1,2})([/-])(\d{1,2})\2(\d{2,4})\b"
DATE_NAMED = r"\b(\d{1,2})([\s\-/]?)([A-Za-z]{3})([a-z]*)([\s\-/]?)(\d{2,4})\b"
DATE_LEADING = r"\b([A-Za-z]{3})[a-z]*\s+(\d{1,2}),?\s+(\d{4})\b"
DATE_NUMERIC_BLANK = r"\b\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}\b"
DATE_NAMED_BLANK = r"\b\d{1,2}[\s\-]?[A-Za-z]{3}[\s\-]?\d{2,4}\b"
DATE_NUMERIC_MASK, DATE_NAMED_MASK = "99/99/99", "99-XXX-99"
TIME = r"\b\d{1,2}:\d{2}(:\d{2})?\b"
TIME_MASK = "99:99"
NAME_TITLED = r"\b((?:Mr|Mrs|Ms|Dr|Shri|Smt|Sri|Kum)\.?\s+)([A-Z][A-Za-z.'-]*(?:\s+[A-Z][A-Za-z.'-]*){0,4})"
NAME_TO = r"\b(To\s+)([A-Za-z][A-Za-z\s.'-]{2,40}?)(?=\s*(?:\n|$|On\b|Ref\b|UPI\b))"
NAME_FROM = r"\b(from\s+)([A-Z][A-Za-z\s.'-]{2,40}?)(?=\s*(?:\n|$|on\b|ref\b|\.))"
NAME_DEAR = r"\b(Dear\s+)([A-Za-z][A-Za-z\s.'-]{2,40}?)(?=\s*[,\n]|$)"
NAME_RECEIVED = r"\b(received by\s+)([A-Za-z][A-Za-z\s.'-]{2,40}?)(?=\s*(?:on\b|at\b|[,.\n]|$))"
NAME_CREDITED = r"\b(credited by\s+)([A-Z][A-Za-z\s.'-]{2,40}?)(?=\s*(?:on\b|[,.\n]|$))"
NAME_PAYMENT = r"\b(payment of [^\n]{0,30}?\bto\s+)([A-Z][A-Za-z\s.'-]{2,40}?)(?=\s*[,.\n]|$)"
NAME_INITIALS = r"\b((?:[A-Z]\s+){1,4}[A-Z]{2,}(?:\s+[A-Z]{2,})*)\b"
NAME_CAPS = r"\b([A-Z]{2,}(?:\s+[A-Z]+){1,4})\b"
NAME_SALUTATION = r"^([A-Z][A-Za-z.'-]{2,30}(?:\s+[A-Z][A-Za-z.'-]{1,30}){0,3})\s*,\s*$"
LEAKS = (
    ("an email address", r"\b[\w.+-]+@[\w-]+\.[\w.]{2,}\b", ""),
    ("a phone number", r"(?<!\d)(?:\+91[-\s]?)?[6-9]\d{9}(?!\d)", ""),
    ("a long digit run", r"(?<!\d)\d{11,}(?!\d)", ""),
    ("a PAN", r"\b[A-Z]{5}\d{4}[A-Z]\b", ""),
    ("an IFSC code", r"\b[A-Z]{4}0[A-Z0-9]{6}\b", ""),
    ("a live link", r"https?:\/\/(?!REDACTED)\S{6,}", ""),
    ("an unmasked amount", r"(?:INR|Rs\.?|₹)\s*\d*[1-8]\d*", "i"),
)
PLACEHOLDER = r"^(?:[9X]+|REDACTED\S*|EMAIL_REDACTED|AADHAAR_REDACTED|PANXXXXXXXXX|IFSC0XXXXXX|APPLICATION_ID|1800XXXXXX|9999999999@\w+)$"
PLACEHOLDER_FILL = r"^[9X*x\s./-]+$"
# words which a name rule must not take for a name; callers add their own through an argument
# (the bulk rules know these, the rules for single reports those of NOT_NAMES_SESSION, too)
NOT_NAMES = (
    "hdfc", "icici", "axis", "sbi", "kotak", "yes", "idfc", "indusind", "rbl",
    "amex", "american", "express", "paytm", "phonepe", "gpay", "google", "play",
    "amazon", "flipkart", "swiggy", "zomato", "uber", "ola", "rapido", "airtel",
    "jio", "vodafone", "idea", "netflix", "spotify", "irctc", "razorpay", "payu",
    "bank", "credit", "debit", "card", "account", "acc", "a/c", "upi", "neft",
    "imps", "rtgs", "atm", "pos", "ref", "refno", "rrn", "txn", "transaction",
    "dear", "customer", "user", "sent", "from", "to", "on", "not", "you", "call",
    "sms", "block", "update", "alert", "low", "balance", "funds", "mandate",
    "payee", "beneficiary", "statement", "generated", "delivered", "please",
    "thank", "your", "the", "for", "and", "has", "have", "been", "will", "is",
    "was", "rs", "inr", "usd", "min", "due", "date", "total", "limit", "ltd",
    "limited", "pvt", "private", "services", "service", "solutions", "india",
    "digital", "technologies", "enterprises", "mr", "mrs", "ms", "dr", "shri",
    "smt", "team", "bill", "pay", "payment", "app", "link", "click", "visit",
    "valid", "till", "off", "get", "now", "new", "old", "yesterday",
    "track", "view", "know", "check", "enable", "disable", "restore", "avoid",
    "redeem", "reset", "activate", "download", "register", "confirm", "verify",
    "continue", "learn", "report", "unblock", "dispute", "add", "added", "make",
)
NOT_NAMES_SESSION = (
    "bob", "canara", "pnb", "union", "federal", "bandhan", "au", "ujjivan", "equitas", "dbs", "hsbc", "citi",
    "standard", "chartered", "zepto", "blinkit", "utr", "available", "avbl", "today",
    "info", "help", "support", "branch", "ifsc", "cheque", "deposit", "withdrawal", "interest", "emi", "loan",
    "stop", "start", "quit", "unsub", "resume", "active", "inactive", "no", "ok", "done", "fail", "failed", "success",
    "dormant", "kyc", "ckyc", "rekyc", "fastag", "netc", "wallet", "reload", "autopay", "smartpay", "mycards", "imobile",
    "netbanking", "mobilebanking", "vpa", "qr", "otp", "pin", "mpin", "cvv", "nach", "ecs",
    "declined", "reversed", "reversal", "refund", "cashback", "reward", "overdue",
    "telecom", "regulatory", "authority", "npci", "rbi", "trai", "uidai", "government", "dept", "department",
    "notice", "attention", "important", "reminder", "congratulations", "welcome", "thanks",
    "regards", "care", "relationship", "manager", "rm", "nominee", "nomination",
)

# --- fixed values: message shapes ----------------------------------------------------------------
SHAPE_STEPS = (
    (r"\d+[.,]\d{2}", "<AMT>"),
    (r"\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}", "<DATE>"),
    (r"\d{1,2}[\s\-/]?[A-Za-z]{3}[\s\-/]?\d{2,4}", "<DATE>"),
    (r"\d{1,2}:\d{2}(:\d{2})?", "<TIME>"),
    (r"\b[Xx*]{1,4}\d{3,6}\b", "<ACCT>"),
    (r"\b\d{6,}\b", "<REF>"),
    (r"\b\d+\b", "<N>"),
    (r"\bPERSON_[0-9a-f]+\b", "<NAME>"),
    (r"\bVPA_[0-9a-f]+\b", "<VPA>"),
    (r"https?://\S+|REDACTED\.LINK\S*", "<URL>"),
    (r"\s+", " "),
)
CLAIMED_DATE_FORMS = (
    r"\b\d{1,2}[\/\-]\d{1,2}[\/\-]\d{2,4}\b",
    r"\b\d{1,2}[\s\-\/]?[A-Za-z]{3}[a-z]*[\s\-\/]?\d{2,4}\b",
)
