"""Small fixed lookup rows: token and indicator patterns, names, advice, tactics."""

# Per-line token patterns (Python ``re`` syntax).
IP_TOKEN = r"\b((?:\d{1,3}\.){3}\d{1,3})\b"
USER_TOKEN = r"(?:user|username|account)[=: ]+([a-zA-Z0-9_\-\.]+)"  # ignores case
EVENT_ID_TOKEN = r"EventID[=: ]+(\d+)"  # ignores case
TIMESTAMP_TOKEN = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}"

# Indicator patterns, case kept.
IOC_PATTERNS = (
    ("md5", r"\b[a-fA-F0-9]{32}\b"),
    ("sha1", r"\b[a-fA-F0-9]{40}\b"),
    ("sha256", r"\b[a-fA-F0-9]{64}\b"),
    ("ipv4", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("url", r"https?://[^\s\"'<>]+"),
    ("domain", r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?\.)+"
               r"(?:com|net|org|io|xyz|info|ru|cn|tk|top|cc|pw|biz|me|co|uk|de|fr)\b"),
    ("email", r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b"),
    ("cve", r"CVE-\d{4}-\d{4,7}"),
)

# Indicator display order and labels.
IOC_LABELS = (
    ("cve", "CVE Identifiers"),
    ("sha256", "SHA-256 Hashes"),
    ("sha1", "SHA-1 Hashes"),
    ("md5", "MD5 Hashes"),
    ("ipv4", "IP Addresses"),
    ("url", "URLs"),
    ("domain", "Domains"),
    ("email", "Email Addresses"),
)

# Indicator type -> STIX object type; types not listed are not exported.
STIX_TYPES = (
    ("ipv4", "ipv4-addr"),
    ("url", "url"),
    ("domain", "domain-name"),
    ("email", "email-addr"),
    ("md5", "file"),
    ("sha1", "file"),
    ("sha256", "file"),
)

# Fixed values: (event_id, name, short_name); no short name where the short list lacks the id.
EVENT_ID_NAMES = (
    ("4624", "Successful Logon", "Successful Logon"),
    ("4625", "Failed Logon", "Failed Logon"),
    ("4648", "Explicit Credential Logon", "Explicit Credential Logon"),
    ("4672", "Special Privileges Assigned", "Special Privileges"),
    ("4698", "Scheduled Task Created", "Sched Task Created"),
    ("4702", "Scheduled Task Updated", "Sched Task Updated"),
    ("4719", "System Audit Policy Changed", "Audit Policy Changed"),
    ("4720", "User Account Created", "User Account Created"),
    ("4723", "Password Change Attempt", None),
    ("4740", "Account Locked Out", "Account Locked Out"),
    ("4769", "Kerberos TGS Requested", "Kerberos TGS Req"),
    ("7045", "New Service Installed", "New Service"),
    ("1102", "Audit Log Cleared", "Audit Log Cleared"),
    ("104", "System Log Cleared", "System Log Cleared"),
    ("4663", "Object Access Attempt", None),
    ("4703", "Token Rights Adjusted", None),
    ("5140", "Network Share Accessed", None),
    ("4778", "RDP Session Reconnected", "RDP Session Reconnected"),
    ("4779", "RDP Session Disconnected", None),
    ("5861", "WMI Event Subscription", "WMI Subscription"),
)

# Fixed values: (trigger rules, trigger correlation, advice); any trigger is enough.
RECOMMENDATIONS = (
    (("log_tampering",), None,
     "URGENT: Event logs were cleared — treat as active incident, isolate system immediately"),
    (("credential_dumping", "dcsync_attack"), None,
     "URGENT: Credential dumping detected — rotate ALL domain credentials immediately"),
    (("ransomware",), None,
     "CRITICAL: Ransomware indicators found — isolate affected systems, activate IR plan"),
    (("golden_silver_ticket", "kerberoasting"), None,
     "Reset krbtgt password twice; audit all service account SPNs"),
    (("command_and_control", "reverse_shell"), None,
     "Block identified C2 IPs/domains; check for persistence mechanisms"),
    (("brute_force",), None,
     "Enable account lockout policy; consider MFA; review source IPs"),
    (("privilege_escalation", "uac_bypass"), None,
     "Audit privileged accounts; apply principle of least privilege"),
    (("persistence", "scheduled_task", "wmi_persistence"), None,
     "Audit all scheduled tasks, services, WMI subscriptions, and run keys"),
    (("sql_injection", "command_injection"), None,
     "Patch web application; implement WAF; review code for injection flaws"),
    (("webshell_detection",), None,
     "URGENT: Web shell detected — scan all web-accessible directories, rebuild from clean source"),
    (("fileless_malware", "amsi_bypass"), None,
     "Enable PowerShell ScriptBlock logging; restrict PowerShell execution policy"),
    (("container_escape",), None,
     "Review container security: disable privileged mode, implement seccomp profiles"),
    ((), "Full Kill Chain Detected",
     "CRITICAL: Full attack kill chain detected — activate full incident response immediately"),
    (("mining_pool", "xmrig_detect"), None,
     "Cryptominer detected — scan for unauthorized processes, review resource usage"),
    (("phishing_url", "credential_harvest"), None,
     "Phishing campaign detected — alert users, block identified phishing domains"),
    (("scada_ics_abuse",), None,
     "URGENT: ICS/SCADA attack detected — isolate OT network, engage OT security team"),
    (("ntds_dit_extraction",), None,
     "URGENT: NTDS.dit extraction — assume full domain compromise, begin recovery"),
    (("disable_firewall", "av_tamper"), None,
     "Security controls disabled — re-enable, investigate scope of compromise"),
)
DEFAULT_RECOMMENDATION = "Continue monitoring; no critical actions required at this time"

# Tactics in display order.
TACTICS = (
    "Initial Access / Auth", "Execution", "Persistence", "Privilege Escalation",
    "Defense Evasion / Injection", "Credential Access", "Discovery",
    "Lateral Movement", "C2", "Exfiltration", "Impact",
)
# Fixed values: (tactic, words); the first tactic with a word in the technique name wins.
TACTIC_WORDS = (
    ("Initial Access / Auth", ("Logon", "Account")),
    ("Defense Evasion / Injection", ("Inject", "Token")),
    ("Credential Access", ("Kerberos", "Ticket")),
    ("C2", ("C2", "Protocol", "Proxy")),
    ("Exfiltration", ("Exfil", "Clipboard")),
)

# Score at or above -> level.
THREAT_LEVELS = ((80, "CRITICAL"), (60, "HIGH"), (40, "MEDIUM"), (20, "LOW"))
LOWEST_LEVEL = "MINIMAL"

# Keyword-rule level -> weight; other levels count as the default.
KEYWORD_WEIGHTS = (("LOW", 5), ("MEDIUM", 15), ("HIGH", 25), ("CRITICAL", 40))
KEYWORD_DEFAULT = ("MEDIUM", 15)
KEYWORD_CATEGORY = "Sigma Rule"
