"""Reference lists. They must be these for the features to come out right."""

BRAND_DOMAINS = [
    "microsoft.com", "paypal.com", "amazon.com", "apple.com", "google.com", "netflix.com", "chase.com", "wellsfargo.com", "bankofamerica.com", "dropbox.com",
    "linkedin.com", "docusign.com", "adobe.com", "salesforce.com", "okta.com", "zoom.us", "office365.com", "onedrive.com", "intuit.com", "quickbooks.intuit.com", "company.com",
]
FREE_MAIL = ["gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "protonmail.com"]
SUSPICIOUS_TLDS = [".xyz", ".top", ".click", ".ml", ".tk", ".ga", ".cf", ".pw", ".icu", ".vip", ".work", ".loan", ".win", ".download", ".stream", ".online", ".site", ".biz"]
SHORTENERS = ["bit.ly", "tinyurl.com", "t.co", "ow.ly", "goo.gl", "rb.gy", "cutt.ly", "short.io"]
EXECUTABLE_EXT = [".exe", ".bat", ".cmd", ".ps1", ".sh", ".vbs", ".js", ".jar", ".msi", ".scr", ".com"]
MACRO_EXT = [".xlsm", ".docm", ".pptm", ".xltm", ".dotm", ".xlam"]
ARCHIVE_EXT = [".zip", ".rar", ".7z", ".tar", ".gz", ".bz2", ".iso"]
OFFICE_EXT = [".doc", ".xls", ".ppt", ".docx", ".xlsx", ".pptx"]
SOURCE_QUALITY = ["nazario", "iwspa", "spamassassin", "trec", "ceas", "kaggle", "synthetic"]
SECOND_LEVEL = ["co", "com", "gov", "org", "ac", "net"]
SPAM_LABELS = ["spam", "0", "junk", "bulk", "unsolicited", "ham"]
PHISHING_LABELS = ["phishing", "phish", "malicious", "fraud", "1"]
FEATURE_VECTOR = [
    "display_from_mismatch", "reply_to_mismatch", "free_email_sender", "url_count", "domain_count", "shortened_url_present", "suspicious_tld_present", "ip_literal_url", "url_entropy", "typosquatting_detected",
    "has_attachment", "subject_length", "body_length", "uppercase_ratio", "digit_ratio", "punctuation_density", "link_density", "brand_mention", "sender_brand_mismatch",
]
