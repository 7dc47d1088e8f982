"""Captions, stems and words that rules look for."""

# Word lists that must equal those of the system this engine stands in for.
CAPTIONS = [
    "name", "full name", "account holder", "holder name", "customer name",
    "father name", "father's name", "mother name", "mother's name", "guardian",
    "account", "account no", "account number", "a/c no", "customer id", "client id",
    "ifsc", "ifsc code", "micr", "branch", "branch name", "bank", "bank name",
    "pan", "pan no", "aadhaar", "aadhar", "uid", "uidai", "passport", "passport no",
    "voter id", "driving licence", "driving license", "dl no", "gstin", "gst no",
    "dob", "d.o.b", "date of birth", "birth date", "age", "gender", "sex",
    "address", "residential address", "permanent address", "correspondence address",
    "city", "state", "district", "pin", "pincode", "pin code", "postal code", "country",
    "communication address", "mailing address", "office address",
    "mobile", "mobile no", "mobile number", "phone", "phone no", "phone number",
    "telephone", "contact", "contact no", "registered mobile",
    "email", "email id", "email address", "e-mail",
    "amount", "total", "subtotal", "grand total", "balance", "opening balance",
    "closing balance", "available balance", "credit", "debit", "salary", "gross salary",
    "net salary", "net pay", "gross pay", "deductions", "tax", "tds",
    "date", "issue date", "expiry", "expiry date", "valid till", "valid from",
    "invoice no", "bill no", "receipt no", "reference", "reference no", "ref no",
    "transaction id", "utr", "order id", "policy no", "policy number",
    "employee id", "employee name", "emp id", "employee code", "designation", "department",
    "basic", "basic pay", "hra", "lta", "da", "pf", "epf", "esi", "esi no", "uan", "uan no",
    "special allowance", "conveyance", "medical allowance", "professional tax", "prof tax",
    "income tax", "bonus", "incentive", "overtime", "gratuity", "arrears",
    "earnings", "total earnings", "total deductions", "net payable", "net pay",
    "days worked", "lop", "pay period", "pay date", "mode of payment",
    "patient name", "patient id", "doctor", "hospital", "diagnosis", "uhid",
    "statement period", "period", "description", "particulars", "narration",
    "relationship manager", "nominee", "signature", "remarks", "status", "type",
    "नाम", "पता", "जन्म तिथि", "मोबाइल",
]
#: Captions that only the gate knows besides.
GATE_CAPTIONS = [*CAPTIONS, "पिता", "पति", "माता", "s/o", "d/o", "w/o", "c/o"]
ADDRESS_STEMS = [
    "c/o", "co", "s/o", "so", "d/o", "w/o",
    "address", "addr", "po", "post", "vtc", "village", "town", "city",
    "district", "dist", "sub district", "subdistrict", "state", "street",
    "house", "flat", "landmark", "pin", "pincode", "pin code", "postal code",
]
SENSITIVE_STEMS = [
    *ADDRESS_STEMS,
    "name", "father", "mother", "husband", "guardian",
    "dob", "date of birth", "birth", "age",
    "mobile", "phone", "tel", "email", "e-mail",
    "account", "card", "customer id", "employee",
    "नाम", "पिता", "पति", "माता", "जन्म तिथि", "मोबाइल", "पता",
]
NEIGHBOUR_STEMS = [
    "name", "नाम", "holder", "nominee", "father", "पिता", "mother", "माता",
    "spouse", "husband", "पति", "wife", "guardian",
    "s/o", "d/o", "w/o", "c/o",
    "dob", "date of birth", "birth", "जन्म तिथि", "age",
    "address", "addr", "पता",
    "mobile", "phone", "tel", "मोबाइल", "email", "e-mail",
    "account", "card", "customer id", "employee",
    "pan", "aadhaar", "aadhar", "passport", "voter",
    "ifsc", "micr", "iban", "upi", "vpa", "gstin",
    "patient", "uhid", "policy no",
    "po", "post", "vtc", "village", "town", "city",
    "district", "dist", "sub district", "subdistrict", "state", "street",
    "house", "flat", "landmark", "pin", "pincode", "pin code", "postal code",
]
ISSUER_PHRASES = [
    "government of india", "govt of india", "govt. of india",
    "republic of india", "bharat sarkar", "भारत सरकार",
    "income tax department", "unique identification authority of india",
    "unique identification authority", "election commission of india",
    "permanent account number", "permanent account number card",
    "ministry of external affairs", "passport office",
    "reserve bank of india", "आयकर विभाग",
]
INSTITUTION_WORDS = [
    "department", "authority", "government", "govt", "republic", "commission",
    "ministry", "bureau", "corporation", "municipal", "municipality",
    "university", "college", "institute", "hospital", "clinic",
    "limited", "ltd", "pvt", "private", "llp", "inc", "gmbh",
    "bank", "insurance", "assurance", "trust", "foundation", "society",
    "board", "council", "federation", "association", "agency",
]
#: Patterns of words in captions of private values, and captions that are never private.
PRIVATE_WORDS = [
    "name", "holder", "nominee", "father", "mother", "spouse", "guardian",
    "manager",
    "dob", "d\\.?o\\.?b", "date of birth", "birth date", "born",
    "address", "residence", "residential", "permanent address", "communication",
    "mobile", "phone", "telephone", "contact", "email", "e-?mail",
    "pan", "aadhaar", "aadhar", "uid", "uidai", "passport", "voter",
    "driving licence", "driving license", "dl no", "licence no", "license no",
    "account no", "account number", "a/?c no", "acct", "ifsc", "micr", "iban",
    "customer id", "client id", "crn", "cif", "uan", "esi", "pf no", "pf number",
    "upi", "vpa", "gstin", "card no", "card number",
    "employee id", "emp id", "patient", "uhid", "policy no", "policy number",
    "नाम", "पता", "जन्म तिथि", "मोबाइल",
]
PUBLIC_CAPTIONS = [
    "bank name", "bank branch", "branch", "company", "employer", "organisation",
    "organization", "firm name", "doctor", "hospital name", "designation", "department",
    "scheme", "product", "currency", "statement period", "period", "description",
    "particulars", "narration", "mode", "status", "type", "nature",
]
HEADER_WORDS = [
    "bank", "co-?op", "cooperative", "ltd", "limited", "pvt", "private", "llp", "inc",
    "corp", "corporation", "technologies", "solutions", "services", "enterprises",
    "industries", "hospital", "clinic", "pharmacy", "university", "college", "school",
    "trust", "society", "authority", "government", "department of",
    "statement", "payslip", "pay slip", "salary slip", "invoice", "receipt", "form",
    "kyc", "ckyc", "certificate", "summary",
]
