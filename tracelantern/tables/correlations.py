"""Multi-rule correlations: every listed rule must have fired in the same file."""

# Fixed values: (name, severity, score_boost, requires, description)
CORRELATIONS = (
    ("Credential Compromise Chain", "CRITICAL", 20,
     ("brute_force", "privilege_escalation"),
     "Brute-force followed by privilege escalation — likely credential compromise leading to escalation"),
    ("Full Kill Chain Detected", "CRITICAL", 30,
     ("credential_dumping", "lateral_movement", "data_exfiltration"),
     "Credential theft → lateral movement → data exfiltration — full attack kill chain"),
    ("Ransomware Deployment Chain", "CRITICAL", 25,
     ("lateral_movement", "av_tamper", "ransomware"),
     "Lateral movement with AV disabling followed by ransomware — coordinated ransomware attack"),
    ("Active C2 with Exfiltration", "CRITICAL", 20,
     ("command_and_control", "data_exfiltration"),
     "Active C2 channel combined with data exfiltration — ongoing data breach"),
    ("Persistence + Defense Evasion", "CRITICAL", 15,
     ("persistence", "log_tampering"),
     "Persistence mechanism deployed with log clearing — adversary covering tracks"),
    ("Insider Threat Indicators", "HIGH", 15,
     ("off_hours_access", "bulk_download"),
     "Off-hours access combined with bulk downloads — potential malicious insider activity"),
    ("AD Compromise Chain", "CRITICAL", 30,
     ("ad_recon", "kerberoasting", "golden_silver_ticket"),
     "AD recon → Kerberoasting → Golden Ticket — full Active Directory compromise"),
    ("Supply Chain + Persistence", "CRITICAL", 20,
     ("dependency_confusion", "persistence"),
     "Supply chain compromise with persistence — advanced persistent threat activity"),
    ("Web Attack to Shell", "CRITICAL", 20,
     ("sql_injection", "reverse_shell"),
     "SQL injection leading to reverse shell — web application fully compromised"),
    ("Phishing to Credential Dump", "CRITICAL", 20,
     ("phishing_url", "credential_dumping"),
     "Phishing campaign followed by credential dumping — social engineering attack chain"),
    ("API Attack Chain", "CRITICAL", 20,
     ("jwt_abuse", "broken_auth_api"),
     "JWT abuse combined with BOLA — API fully compromised"),
    ("AI System Compromise", "CRITICAL", 25,
     ("prompt_injection", "data_extraction_llm"),
     "Prompt injection leading to training data extraction — AI system compromised"),
    ("MFA Bypass + Lateral Movement", "CRITICAL", 25,
     ("mfa_fatigue", "lateral_movement"),
     "MFA bypass via fatigue followed by lateral movement — identity compromise"),
    ("Crypto Theft Chain", "CRITICAL", 25,
     ("wallet_theft", "crypto_clipper"),
     "Wallet theft combined with clipboard hijacking — cryptocurrency attack chain"),
    ("Network MitM + Credential Theft", "CRITICAL", 20,
     ("arp_poisoning", "credential_dumping"),
     "ARP poisoning leading to credential capture — network-level MitM attack"),
)
