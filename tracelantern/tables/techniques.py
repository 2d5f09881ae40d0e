"""Attack technique names by technique id."""

# Fixed values: (technique_id, technique_name)
TECHNIQUES = (
    ("T1110", "Brute Force"),
    ("T1110.001", "Password Guessing"),
    ("T1110.003", "Password Spraying"),
    ("T1078", "Valid Accounts"),
    ("T1078.001", "Default Accounts"),
    ("T1078.002", "Domain Accounts"),
    ("T1136.001", "Create Local Account"),
    ("T1098", "Account Manipulation"),
    ("T1021", "Remote Services"),
    ("T1021.001", "Remote Desktop Protocol"),
    ("T1021.002", "SMB/Windows Admin Shares"),
    ("T1021.003", "Distributed COM"),
    ("T1021.004", "SSH"),
    ("T1134", "Access Token Manipulation"),
    ("T1134.001", "Token Impersonation/Theft"),
    ("T1548.002", "Bypass UAC"),
    ("T1548.003", "Sudo & Sudo Caching"),
    ("T1574.001", "DLL Search Order Hijacking"),
    ("T1543.003", "Windows Service"),
    ("T1053.005", "Scheduled Task"),
    ("T1547.001", "Registry Run Keys / Startup"),
    ("T1542.003", "Bootkit"),
    ("T1546.003", "WMI Event Subscription"),
    ("T1546.012", "Image File Execution Options Injection"),
    ("T1546.015", "COM Hijacking"),
    ("T1197", "BITS Jobs"),
    ("T1550.002", "Pass the Hash"),
    ("T1047", "WMI"),
    ("T1219", "Remote Access Software"),
    ("T1071.001", "Web Protocols"),
    ("T1071.004", "DNS"),
    ("T1090.003", "Multi-hop Proxy (Tor)"),
    ("T1090.004", "Domain Fronting"),
    ("T1059", "Command & Scripting Interpreter"),
    ("T1059.001", "PowerShell"),
    ("T1095", "Non-Application Layer Protocol"),
    ("T1568.001", "Fast Flux DNS"),
    ("T1041", "Exfiltration Over C2"),
    ("T1115", "Clipboard Data"),
    ("T1048.002", "Exfil Over Alt Protocol - SMTP"),
    ("T1048.003", "Exfil Over Alt Protocol - DNS"),
    ("T1027", "Obfuscated Files or Information"),
    ("T1027.001", "Binary Padding"),
    ("T1027.003", "Steganography"),
    ("T1567.002", "Exfil to Cloud Storage"),
    ("T1070.001", "Clear Windows Event Logs"),
    ("T1070.006", "Timestomp"),
    ("T1055", "Process Injection"),
    ("T1562.001", "Disable/Modify Tools"),
    ("T1562.004", "Disable Firewall"),
    ("T1562.006", "Indicator Blocking (ETW)"),
    ("T1564.004", "NTFS File Attributes (ADS)"),
    ("T1046", "Network Service Discovery"),
    ("T1087.001", "Local Account Discovery"),
    ("T1087.002", "Domain Account Discovery"),
    ("T1082", "System Information Discovery"),
    ("T1615", "Group Policy Discovery"),
    ("T1518.001", "Security Software Discovery"),
    ("T1135", "Network Share Discovery"),
    ("T1003.001", "LSASS Memory"),
    ("T1003.002", "SAM"),
    ("T1003.003", "NTDS"),
    ("T1003.006", "DCSync"),
    ("T1552.001", "Credentials In Files"),
    ("T1552.005", "Cloud Instance Metadata"),
    ("T1190", "Exploit Public-Facing Application"),
    ("T1189", "Drive-by Compromise"),
    ("T1083", "File & Directory Discovery"),
    ("T1486", "Data Encrypted for Impact (Ransomware)"),
    ("T1105", "Ingress Tool Transfer"),
    ("T1080", "Taint Shared Content"),
    ("T1204.002", "Malicious File"),
    ("T1505.003", "Web Shell"),
    ("T1557.001", "LLMNR/NBT-NS Poisoning"),
    ("T1558.001", "Golden Ticket"),
    ("T1558.003", "Kerberoasting"),
    ("T1611", "Escape to Host (Container)"),
    ("T1195.002", "Compromise Software Supply Chain"),
    ("T0855", "Unauthorized Command Message (ICS)"),
    ("T0831", "Manipulation of Control (ICS)"),
    ("T0883", "Change Program State (ICS)"),
    ("T1005", "Data from Local System"),
    ("T1530", "Data from Cloud Storage"),
    ("T1052.001", "Exfil Over USB"),
    ("T1203", "Exploitation for Client Execution"),
    ("T1566.001", "Spearphishing Attachment"),
    ("T1566.002", "Spearphishing Link"),
    ("T1566.003", "Spearphishing via Service"),
    ("T1496", "Resource Hijacking (Cryptomining)"),
    ("T1528", "Steal Application Access Token"),
    ("T1621", "Multi-Factor Authentication Request Generation"),
    ("T1550", "Use Alternate Authentication Material"),
    ("T1606.002", "SAML Tokens"),
    ("T1556", "Modify Authentication Process"),
    ("T1558", "Steal or Forge Kerberos Tickets"),
    ("T1557", "Adversary-in-the-Middle"),
    ("T1557.002", "ARP Cache Poisoning"),
    ("T1599", "Network Boundary Bridging"),
)
