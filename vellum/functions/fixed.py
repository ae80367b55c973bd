"""Patterns, word lists, messages and version numbers that results depend on."""

# Severities, the worst first.
SEVERITIES = ("error", "warning", "info")

# Patterns of the line rules.
AWS_KEY_ID = r"(?:A3T[A-Z0-9]|AKIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA|ASIA)[A-Z0-9]{16}"
AWS_SECRET = r"""(?:aws_secret_access_key|secret.?key)\s*[=:]\s*['"]?([A-Za-z0-9/+=]{40})['"]?"""
PII = {
    "ssn": (r"\b\d{3}-\d{2}-\d{4}\b", "Possible SSN detected."),
    "email": (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "Email address detected."),
    "phone-us": (r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", "Possible US phone number detected."),
    "credit-card": (r"\b(?:\d{4}[-\s]?){3}\d{4}\b", "Possible credit card number detected."),
}
LIST_MARKER = r"^(\s*)([-*+]|\d+[.)]) "

# Passive voice.
IRREGULAR_PARTICIPLES = (
    "built", "chosen", "done", "drawn", "driven", "eaten", "fallen", "felt", "found", "given", "gone", "grown", "held", "hidden", "hit", "kept",
    "known", "laid", "led", "lent", "lost", "made", "meant", "met", "paid", "put", "read", "run", "said", "seen", "sent", "set", "shown", "shut",
    "sold", "spoken", "spent", "stood", "taken", "taught", "thought", "told", "understood", "won", "worn", "written",
)
PASSIVE = r"\b(is|are|was|were|be|been|being)\s+(\w+ed|" + "|".join(IRREGULAR_PARTICIPLES) + r")\b"
STATIVE = [
    "is based", "are based", "is used", "are used", "is required", "are required", "is needed", "are needed",
    "is located", "are located", "is designed", "are designed", "is expected", "are expected", "is supposed", "are supposed",
]

# Words that a title may keep in lower case.
SMALL_WORDS = ["a", "an", "the", "and", "but", "or", "for", "nor", "in", "on", "at", "to", "by", "of", "up", "is"]

# Current platform versions.
PLATFORM_VERSIONS = {"iOS": 18.0, "iPadOS": 18.0, "macOS": 15.0, "tvOS": 18.0, "watchOS": 11.0, "visionOS": 2.0, "Mac Catalyst": 18.0}

# The general glossary, (pattern, preferred, severity), matched without case.
GENERAL_TERMS = [
    (r"\bblacklist\b", "blocklist", "warning"),
    (r"\bwhitelist\b", "allowlist", "warning"),
    (r"\bmaster\b(?:\s+branch)?", "main", "info"),
    (r"\bslave\b", "replica / secondary / follower", "warning"),
    (r"\bsimply\b|\bjust\b|\beasy\b|\bobviously\b", "(remove the word)", "info"),
    (r"\betc\.?\b", "(be specific)", "info"),
    (r"\bplease\b", "(remove or rephrase)", "info"),
    (r"\bhe\b|\bshe\b|\bhis\b|\bher\b", "they / their / the user", "info"),
]

# The product glossary, matched with case, all info.
PRODUCT_TERMS = [
    (r"\bVisionOS\b|\bVision OS\b|\bvision os\b|\bVISIONOS\b|\bvision OS\b", "visionOS"),
    (r"\bSwift UI\b|\bswiftui\b|\bSWIFTUI\b|\bswiftUI\b|\bSwiftui\b", "SwiftUI"),
    (r"\bUI Kit\b|\bUikit\b|\bUIKIT\b|\buikit\b|\bUi Kit\b", "UIKit"),
    (r"\bXCode\b|\bxcode\b|\bXCODE\b|\bX-Code\b|\bx code\b", "Xcode"),
    (r"\bAppStore\b|\bapp store\b|\bappstore\b|\bAPP STORE\b", "App Store"),
    (r"\bICloud\b|\bicloud\b|\bICLOUD\b|\bi Cloud\b|\bI Cloud\b", "iCloud"),
    (r"\bMacOS\b|\bMACOS\b|\bMac OS\b|\bmacos\b|\bOSX\b|\bOS X\b", "macOS"),
    (r"\bIOS\b|\bIos\b|\bi OS\b", "iOS"),
    (r"\bWatchOS\b|\bWatch OS\b|\bWATCHOS\b|\bwatchos\b", "watchOS"),
    (r"\bTvOS\b|\bTVOS\b|\bTv OS\b|\btvos\b", "tvOS"),
    (r"\bIpadOS\b|\biPados\b|\bIPADOS\b|\bipad os\b|\bIPad OS\b", "iPadOS"),
]

# Identifiers of API reference pages.
EXTERNAL_PREFIX = "doc://com.externally.resolved.symbol/"
INTERNAL_PREFIX = r"^doc://com\.apple\.\w+/documentation/"
PAGE_URL = "https://developer.apple.com/tutorials/data/documentation"
