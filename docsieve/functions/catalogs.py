"""Pattern catalogs, dictionaries and lookup tables.

The values in this module are fixed: results depend on them, so they are stated as they are. Patterns are written for
Java's and Python's common syntax; two are flattened or bounded so that no repeated group can exhaust the regex stack.
The order of a catalog is part of its meaning: it breaks ties between findings that start at the same place.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Pattern:
    """A named detector: its regular expression, what replaces a match, and its weight in the risk score.

    ``needs``: a text can only match if it holds one of these strings (in lower case), or a digit where it is ``DIGIT``.
    """

    name: str
    regex: str
    replacement: str = "[PII]"
    weight: int = 1
    needs: tuple[str, ...] = ()


DIGIT = ("0-9",)


#: Personal data, matched without regard to case.
PERSONAL = (
    Pattern("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL]", 4, needs=("@",)),
    Pattern("phone", r"(\+?1[-.\s]?)?\(?([0-9]{3})\)?[-.\s]?([0-9]{3})[-.\s]?([0-9]{4})", "[PHONE]", 4, needs=DIGIT),
    Pattern("ssn", r"\b\d{3}-?\d{2}-?\d{4}\b", "[SSN]", 5, needs=DIGIT),
    Pattern("credit_card", r"\b(?:\d{4}[-\s]?){3}\d{4}\b", "[CREDIT_CARD]", 5, needs=DIGIT),
    Pattern("ip_address", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", "[IP_ADDRESS]", 2, needs=DIGIT),
    Pattern("url", r"https?://[!$-_a-z]+", "[URL]", 1, needs=("://",)),
    Pattern("date", r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b\d{4}[/-]\d{1,2}[/-]\d{1,2}\b", "[DATE]", 1, needs=DIGIT),
    Pattern("address", r"\b\d+\s+[A-Za-z\s]+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Place|Pl)\b", "[ADDRESS]", 3, needs=DIGIT),
    Pattern("employee_id", r"\b(?:EMP|ID|E)\d{5,7}\b", "[EMPLOYEE_ID]", 3, needs=DIGIT),
    Pattern("token", r"\b[A-Z]{2}-\d{5,6}-[A-Z]{2,3}\b", "[TOKEN]", 3, needs=DIGIT),
    Pattern("organization", r"\b(?:Department|Dept|Organization|Org|Company|Corp|Corporation|Inc|Ltd)\b", needs=("dep", "org", "comp", "corp", "inc", "ltd")),
    Pattern("system_path", r"\b(?:C:\\|/usr/|/etc/|/var/|\\\\)[a-zA-Z0-9\\_/]+\b", needs=("c:\\", "/usr/", "/etc/", "/var/", "\\\\")),
    Pattern("sensitive_terms", r"\b(?:confidential|secret|internal use only|privileged access|restricted)\b", needs=("confidential", "secret", "internal use only", "privileged access", "restricted")),
)

#: What recognisers and the dictionary of client names find.
ENTITIES = (
    Pattern("PERSON", "", "[PERSON]", 3),
    Pattern("ORG", "", "[ORGANIZATION]", 2),
    Pattern("GPE", "", "[LOCATION]", 1),
    Pattern("client_name", "", "[CLIENT_NAME]", 4),
)

#: Security documents, matched with regard to case.
SPECIALIZED = (
    Pattern("ip_cidr", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}/[0-9]{1,2}\b", "[NETWORK_RANGE]", needs=DIGIT),
    Pattern("ip_address", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", "[IP_ADDRESS]", needs=DIGIT),
    Pattern("port_range", r"\b\d{1,5}(?:-\d{1,5})?\b(?=\s*(?:/(?:tcp|udp|icmp)|$))", "[PORT_RANGE]", needs=DIGIT),
    Pattern("aws_account_id", r"\b\d{12}\b", "[AWS_ACCOUNT]", needs=DIGIT),
    Pattern("aws_arn", r"arn:aws:[a-zA-Z0-9\-]*:[a-zA-Z0-9\-]*:\d{12}:.*", "[AWS_ARN]", needs=("arn:aws:",)),
    Pattern("aws_role_id", r"\b[A-Z]{2}[A-Z0-9]{16,32}\b", "[AWS_ROLE_ID]"),
    Pattern("aws_resource", r"\b(?:role|user|group|policy|bucket|function)/[a-zA-Z0-9_\-\.]+\b", "[AWS_RESOURCE]", needs=("role/", "user/", "group/", "policy/", "bucket/", "function/")),
    Pattern("certificate_titles", r"\b(?:CERTIFICATE\s+OF|CERTIFICATION\s+OF)\s+[A-Z\s]+\b", "[CERTIFICATE_TYPE]", needs=("certificat",)),
    Pattern("authorization_codes", r"\b[A-Z]{2,}-\d{3,}-[A-Z0-9]{2,}\b", "[AUTH_CODE]", needs=DIGIT),
    Pattern("security_levels", r"\b(?:CONFIDENTIAL|SECRET|TOP SECRET|RESTRICTED|INTERNAL USE ONLY)\b", "[SECURITY_LEVEL]", needs=("confidential", "secret", "restricted", "internal use only")),
    Pattern("job_titles", r"\b(?:Security Officer|Administrator|Director|Manager|Supervisor|Engineer|Analyst)\b", "[JOB_TITLE]", needs=("officer", "administrator", "director", "manager", "supervisor", "engineer", "analyst")),
    Pattern("departments", r"\b(?:Security|IT|Information Technology|Operations|Infrastructure)\s+(?:Department|Dept|Team|Group)\b", "[DEPARTMENT]", needs=("dep", "team", "group")),
    Pattern("policy_names", r"\b[A-Za-z0-9\-]+(?:Policy|Role|Group|Permission)s?\b", "[POLICY_NAME]", needs=("policy", "role", "group", "permission")),
    Pattern("resource_names", r"\b(?:Test|Prod|Dev|Stage)-[A-Za-z0-9\-]+\b", "[RESOURCE_NAME]", needs=("test-", "prod-", "dev-", "stage-")),
)

#: Two capitalised words and a title.
TITLED_NAME = Pattern("JOB_TITLE_WITH_NAME", r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\s+(?i:officer|administrator|director|manager|engineer)\b", "[REDACTED]", needs=("officer", "administrator", "director", "manager", "engineer"))

#: Text regions of command lines and cloud consoles; the first that matches decides.
REGIONS = (
    Pattern("arn", r"(?i)arn:aws:iam::\d{12}:(?:role|user|group|policy)[/:][\w+=,.@\-_/]+"),
    Pattern("s3_action", r"(?i)\bs3[:/]\s*(?:get|list|put|delete)\w*\b"),
    Pattern("ip_address", r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b"),
    Pattern("sensitive_words", r"(?i)\b(?:role|user|group|policy|secret|key|password|token|credential)\b"),
    Pattern("phone", r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"),
    Pattern("date", r"\b\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}:\d{2}[-+]\d{2}:\d{2})?\b"),
    Pattern("account_id", r"\b\d{12}\b"),
    Pattern("role_id", r"(?i)\b[A-Z0-9]{21}EXAMPLE\b"),
    Pattern("json_key", r"(?i)\"(?:Role(?:Name|Id|Arn)|Principal|Effect|Action|Version)\":"),
    Pattern("cli_param", r"(?i)--[a-z-]+\s+[\"']?[\w\-./]+[\"']?"),
)

#: Keywords of the region classifier.
REGION_KEYWORDS = ("role", "arn", "aws", "iam", "policy", "user", "group", "secret", "key", "password", "token", "credential", "create-role", "assume-role", "trust-policy", "statement", "principal", "effect", "action")

#: Marks of command-line output.
CLI_MARKERS = ("aws", "iam", "create-role", "assume-role", "Output:", "{", "}", "[", "]")


@dataclass(frozen=True)
class Category:
    """A topic of security content with its weight, what a file about it is called, and advice."""

    name: str
    weight: float
    description: str
    patterns: tuple[str, ...]
    keywords: tuple[str, ...]
    recommendations: tuple[str, str]


#: Security topics.
CATEGORIES = (
    Category(
        "iam_policies",
        0.25,
        "IAM policy configurations",
        (
            r"\b(?:allow|deny)\s+(?:user|group|role)\s+\w+\s+(?:to|from)\s+\w+",
            r"\b(?:grant|revoke)\s+(?:permission|access|privilege)\s+\w+",
            r"\b(?:policy|permission|role|user|group)\s*:\s*[\"']?[\w\-\.]+[\"']?",
            r"\b(?:arn|resource)\s*:\s*[\"']?arn:[\w\-:\/\*]+[\"']?",
            r"\b(?:effect|action|resource|condition)\s*:\s*[\"']?[\w\-\.\*\/]+[\"']?",
            r"\b(?:assume|trust)\s+(?:role|policy)",
        ),
        ("iam", "policy", "permission", "role", "user", "group", "access", "allow", "deny", "grant", "revoke", "assume", "trust", "arn", "resource", "action", "effect", "condition", "principal"),
        ("Review IAM policies for least privilege compliance", "Audit user permissions and role assignments"),
    ),
    Category(
        "firewall_rules",
        0.25,
        "firewall rule definitions",
        (
            r"\b(?:allow|deny|block|drop)\s+(?:tcp|udp|icmp|ip)\s+(?:port\s+)?\d+",
            r"\b(?:source|destination|src|dst)\s+(?:ip|address)?\s*:\s*\d+\.\d+\.\d+\.\d+",
            r"\b(?:port|protocol)\s*:\s*\d+",
            r"\b(?:inbound|outbound|ingress|egress)\s+(?:rule|traffic)",
            r"\b(?:security\s+group|network\s+acl|firewall\s+rule)",
            r"\b(?:tcp|udp|icmp|http|https|ssh|ftp|smtp|dns)\s+(?:port\s+)?\d+",
        ),
        ("firewall", "rule", "allow", "deny", "block", "drop", "port", "protocol", "tcp", "udp", "icmp", "ip", "address", "source", "destination", "inbound", "outbound", "ingress", "egress", "security group", "network acl", "iptables", "netfilter"),
        ("Validate firewall rules for security gaps", "Ensure proper network segmentation"),
    ),
    Category(
        "ids_ips_logs",
        0.20,
        "intrusion detection logs",
        (
            r"\b(?:alert|warning|critical|high|medium|low)\s+(?:severity|priority)",
            r"\b(?:attack|intrusion|malware|virus|trojan|exploit)\s+(?:detected|found|blocked)",
            r"\b(?:signature|rule)\s+id\s*:\s*\d+",
            r"\b(?:src|source)\s+ip\s*:\s*\d+\.\d+\.\d+\.\d+",
            r"\b(?:dst|destination)\s+ip\s*:\s*\d+\.\d+\.\d+\.\d+",
            r"\b(?:snort|suricata|bro|zeek)\s+(?:alert|log|event)",
        ),
        ("ids", "ips", "intrusion", "detection", "prevention", "alert", "signature", "rule", "attack", "malware", "virus", "exploit", "snort", "suricata", "bro", "zeek", "severity", "priority"),
        ("Investigate security alerts and incidents", "Update IDS/IPS signatures and rules"),
    ),
    Category(
        "network_security",
        0.15,
        "network security settings",
        (
            r"\b(?:vpn|ssl|tls|ipsec)\s+(?:connection|tunnel|encryption)",
            r"\b(?:certificate|cert)\s+(?:expired|invalid|revoked)",
            r"\b(?:encryption|cipher|algorithm)\s*:\s*[\w\-]+",
            r"\b(?:vlan|subnet|network)\s+(?:id|address)\s*:\s*[\d\.\/]+",
            r"\b(?:nat|proxy|load\s+balancer)\s+(?:rule|configuration)",
        ),
        ("network", "security", "vpn", "ssl", "tls", "ipsec", "encryption", "certificate", "cipher", "algorithm", "vlan", "subnet", "nat", "proxy", "load balancer", "dmz", "perimeter"),
        ("Review network security configurations", "Validate encryption and certificate settings"),
    ),
    Category(
        "vulnerability_info",
        0.10,
        "vulnerability information",
        (
            r"\bcve-\d{4}-\d{4,}",
            r"\b(?:vulnerability|exploit|cve|cwe)\s+(?:id|number)\s*:\s*[\w\-]+",
            r"\b(?:cvss|score)\s*:\s*\d+\.?\d*",
            r"\b(?:critical|high|medium|low)\s+(?:vulnerability|risk|severity)",
            r"\b(?:patch|update|fix)\s+(?:available|required|installed)",
        ),
        ("vulnerability", "exploit", "cve", "cwe", "cvss", "score", "patch", "update", "fix", "critical", "high", "medium", "low", "severity", "risk", "exposure"),
        ("Prioritize vulnerability remediation", "Implement security patching procedures"),
    ),
    Category(
        "compliance",
        0.05,
        "compliance documentation",
        (
            r"\b(?:pci|dss|hipaa|gdpr|sox|iso\s*27001|nist)\s+(?:compliance|standard|requirement)",
            r"\b(?:audit|assessment|review)\s+(?:finding|result|recommendation)",
            r"\b(?:control|requirement)\s+(?:id|number)\s*:\s*[\w\-\.]+",
            r"\b(?:compliant|non-compliant|violation|exception)",
        ),
        ("compliance", "audit", "assessment", "control", "requirement", "pci", "dss", "hipaa", "gdpr", "sox", "iso", "27001", "nist", "standard", "framework", "regulation", "policy"),
        ("Address compliance gaps and violations", "Schedule regular compliance assessments"),
    ),
)

#: Advice when over two topics stand out.
GENERAL_RECOMMENDATIONS = ("Conduct comprehensive security review", "Implement security monitoring and alerting")

#: Entities of security texts: kind, regex, the group that is the value, whether case counts.
STRUCTURED = (
    ("ip_addresses", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", 0, True),
    ("ports", r"\b(?:port\s+)?(\d{1,5})\b", 1, False),
    ("protocols", r"\b(tcp|udp|icmp|http|https|ssh|ftp|smtp|dns|ssl|tls)\b", 0, False),
    ("domains", r"\b[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?\.(?:[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?\.){0,126}[a-zA-Z]{2,}\b", 0, True),
    ("file_paths", r"(?:[a-zA-Z]:\\|/)[^\s<>\"'|?*\n\r]+", 0, True),
    ("usernames", r"\b(?:user|username|account)\s*[:=]\s*([a-zA-Z0-9_\-\.]+)", 1, False),
    ("timestamps", r"\b\d{4}[-/]\d{1,2}[-/]\d{1,2}[\sT]\d{1,2}:\d{1,2}:\d{1,2}", 0, True),
)

#: Columns of sensitive sheets and what they hold.
SHEET_COLUMNS = {
    "employee full name": "PERSON",
    "employee id": "employee_id",
    "verified by (ra name)": "PERSON",
    "ra signature / initials": "PERSON",
    "authorized by (supervisor)": "PERSON",
    "supervisor email": "email",
    "token serial number": "token",
    "date of authorization": "date",
    "date of in-person verification": "date",
}

#: Levels of risk with the largest score of each.
RISK_LEVELS = (("LOW", 0), ("MEDIUM", 5), ("HIGH", 15), ("CRITICAL", None))

#: Advice by level of risk, then by what was found.
RISK_ADVICE = {
    "LOW": ("Text appears to have minimal PII risk.",),
    "MEDIUM": ("Consider reviewing and masking identified PII before sharing.",),
    "HIGH": ("High PII risk detected. Mask or remove PII before processing.", "Review all named entities and contact information."),
    "CRITICAL": (
        "CRITICAL: Do not share this content without thorough PII removal.",
        "Multiple high-risk PII types detected (SSN, credit cards, etc.).",
        "Consider legal compliance requirements (GDPR, CCPA, etc.).",
    ),
}
FOUND_ADVICE = (
    ("ssn", "SSN detected - ensure compliance with privacy regulations."),
    ("credit_card", "Credit card numbers detected - PCI DSS compliance required."),
    ("email", "Email addresses detected - consider data protection implications."),
)

#: Columns of sheets that are redacted whole, what replaces them, and words of names that look sensitive.
SENSITIVE_SHEET = {
    "employee full name": "PERSON",
    "verified by (ra name)": "PERSON",
    "ra signature / initials": "PERSON",
    "authorized by (supervisor)": "PERSON",
    "supervisor email": "email",
}
SHEET_REPLACEMENTS = {
    "PERSON": "[REDACTED NAME]",
    "email": "[REDACTED EMAIL]",
    "phone": "[REDACTED PHONE]",
    "address": "[REDACTED ADDRESS]",
    "date": "[REDACTED DATE]",
}
SENSITIVE_NAMES = ("name", "email", "phone", "address", "ssn", "social", "birth", "employee")
