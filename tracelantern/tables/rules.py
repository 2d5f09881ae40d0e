"""Detection rules as plain rows; the row order is the evaluation order.

Patterns are written in Python ``re`` syntax and are always searched without
regard to case.  ``tracelantern.functions.dialect`` turns them into Java syntax.
"""

# Fixed values: (rule_id, severity, weight, category, technique_id, description, patterns)
DETECTION_RULES = (
    # Authentication
    ("failed_login", "MEDIUM", 5, "Authentication", "T1110",
     "Failed login attempt detected",
     ("EventID[=: ]*4625", "failed (password|login|auth)", "authentication failure", "invalid (credentials|password|user)",)),
    ("successful_login", "INFO", 1, "Authentication", "T1078",
     "Successful logon event",
     ("EventID[=: ]*4624",)),
    ("anonymous_logon", "HIGH", 20, "Authentication", "T1078.001",
     "Anonymous logon detected - possible unauthenticated access",
     ("ANONYMOUS LOGON", "ANONYMOUS_LOGON",)),
    ("brute_force", "HIGH", 25, "Authentication", "T1110.001",
     "Brute-force or account lockout indicator",
     ("too many (failed|invalid|auth)", "account locked", "EventID[=: ]*4740",)),
    ("password_spray", "HIGH", 20, "Authentication", "T1110.003",
     "Explicit credential use - possible password spray",
     ("EventID[=: ]*4648", "explicit credentials",)),
    ("default_credentials", "CRITICAL", 30, "Authentication", "T1078.001",
     "Default credentials used",
     ("admin:admin|root:root|admin:password|guest:guest",)),
    ("account_creation", "MEDIUM", 15, "Authentication", "T1136.001",
     "New user account created",
     ("EventID[=: ]*4720", "user account (was )?created", "net user.*/add",)),
    ("password_change", "MEDIUM", 10, "Authentication", "T1098",
     "Account password changed or reset",
     ("EventID[=: ]*4723|EventID[=: ]*4724", "password (was )?(changed|reset)",)),
    ("logon_type_anomaly", "MEDIUM", 10, "Authentication", "T1021",
     "Suspicious logon type (Network/RemoteInteractive/NetworkCleartext)",
     (r"Logon Type:\s*(3|10|8)", "LogonType[=: ]*(3|10|8)",)),
    ("service_account_abuse", "HIGH", 25, "Authentication", "T1078.002",
     "Service account anomalous usage",
     ("service account.*login|svc_.*logon", r"Logon Type:\s*5.*elevated",)),
    # Privilege Escalation
    ("privilege_escalation", "HIGH", 30, "Privilege Escalation", "T1134",
     "Special privileges assigned to new logon",
     ("EventID[=: ]*4672", "SeDebugPrivilege|SeTcbPrivilege|SeLoadDriverPrivilege",)),
    ("token_manipulation", "HIGH", 30, "Privilege Escalation", "T1134.001",
     "Token privilege manipulation detected",
     ("EventID[=: ]*4703|EventID[=: ]*4674", "token (impersonation|theft|manipulation)",)),
    ("uac_bypass", "CRITICAL", 40, "Privilege Escalation", "T1548.002",
     "UAC bypass technique detected",
     ("uac.*bypass|bypass.*uac", "eventvwr|fodhelper|sdclt",)),
    ("sudo_abuse", "HIGH", 25, "Privilege Escalation", "T1548.003",
     "Suspicious sudo usage",
     ("sudo.*-s|sudo.*-i|sudo su", "NOPASSWD",)),
    ("named_pipe_impersonation", "HIGH", 30, "Privilege Escalation", "T1134.001",
     "Named pipe impersonation for privilege escalation",
     ("ImpersonateNamedPipeClient|named.?pipe.*impersonat", "pipe.*privilege",)),
    ("dll_search_order_hijack", "HIGH", 30, "Privilege Escalation", "T1574.001",
     "DLL search order hijacking attempt",
     ("dll.*search.*order|dll.*plant|side.?load.*dll", "SetDllDirectory.*null",)),
    ("seimpersonate_abuse", "CRITICAL", 40, "Privilege Escalation", "T1134.001",
     "SeImpersonate privilege abuse (Potato exploit)",
     ("SeImpersonatePrivilege|SeAssignPrimaryToken", "potato.*exploit|juicy.*potato|print.*spoofer",)),
    # Persistence
    ("persistence", "HIGH", 25, "Persistence", "T1543.003",
     "New service created - possible persistence mechanism",
     ("EventID[=: ]*7045", "new service (created|installed)",)),
    ("scheduled_task", "HIGH", 25, "Persistence", "T1053.005",
     "Scheduled task created or modified",
     ("EventID[=: ]*4698|EventID[=: ]*4702", r"schtasks.*create|at\.exe",)),
    ("registry_persistence", "HIGH", 25, "Persistence", "T1547.001",
     "Registry run-key modification - persistence indicator",
     (r"HKCU\\Software\\Microsoft\\Windows\\CurrentVersion\\Run", "HKLM.*Run.*", "reg (add|query).*Run",)),
    ("startup_modification", "MEDIUM", 20, "Persistence", "T1547.001",
     "Startup folder modification detected",
     (r"\\Startup\\", r"\\Start Menu\\Programs\\Startup",)),
    ("dll_hijacking", "CRITICAL", 35, "Persistence", "T1574.001",
     "DLL hijacking or side-loading attempt",
     ("dll (hijack|side.?load|injection)", r"LoadLibrary.*\.dll",)),
    ("bootkit", "CRITICAL", 50, "Persistence", "T1542.003",
     "Bootkit or MBR modification detected",
     ("MBR (modif|write|overwrite|tamper)", "bootkitty|bootsector",)),
    ("wmi_persistence", "CRITICAL", 40, "Persistence", "T1546.003",
     "WMI event subscription persistence",
     ("EventID[=: ]*5861", "__EventFilter|__EventConsumer|CommandLineEventConsumer", "wmi.*subscription.*persist",)),
    ("bits_job_persistence", "HIGH", 25, "Persistence", "T1197",
     "BITS job abused for persistence",
     (r"bitsadmin.*\/SetNotifyCmdLine|bits.*persist", "Start-BitsTransfer.*-Asynchronous",)),
    ("com_hijacking", "HIGH", 30, "Persistence", "T1546.015",
     "COM object hijacking for persistence",
     ("InprocServer32.*modified|COM.*hijack|CLSID.*redirect", "reg.*InprocServer32",)),
    ("image_file_exec_options", "CRITICAL", 35, "Persistence", "T1546.012",
     "Image File Execution Options debugger set - persistence/evasion",
     ("Image File Execution Options|IFEO.*debugger", "GlobalFlag.*0x200",)),
    # Lateral Movement
    ("lateral_movement", "HIGH", 35, "Lateral Movement", "T1021",
     "Lateral movement tools detected (PsExec/WMIC/WinRM)",
     (r"\bpsexec\b", r"\bwmic\b.*/node", "EventID[=: ]*4648", r"\bwinrm\b",)),
    ("pass_the_hash", "CRITICAL", 50, "Lateral Movement", "T1550.002",
     "Pass-the-Hash attack indicator",
     ("pass.?the.?hash|pth attack", "NTLM.*lateral|mimikatz",)),
    ("rdp_anomaly", "MEDIUM", 15, "Lateral Movement", "T1021.001",
     "RDP session reconnected or disconnected",
     ("EventID[=: ]*4778|EventID[=: ]*4779", "TermService|Remote Desktop",)),
    ("smb_anomaly", "HIGH", 30, "Lateral Movement", "T1021.002",
     "Suspicious SMB share access or exploit attempt",
     ("EventID[=: ]*5140|EventID[=: ]*5145", r"\\\\.*\\(ADMIN|C|IPC)\$", "smb (exploit|relay|attack)",)),
    ("dcom_lateral", "HIGH", 30, "Lateral Movement", "T1021.003",
     "DCOM-based lateral movement detected",
     (r"DCOM.*lateral|MMC20\.Application|ShellBrowserWindow", "dcomexec",)),
    ("wmi_lateral", "HIGH", 30, "Lateral Movement", "T1047",
     "WMI-based remote execution for lateral movement",
     ("wmic.*/node:.*process call|Win32_Process.*Create.*remote", "wmiexec",)),
    ("ssh_lateral", "MEDIUM", 15, "Lateral Movement", "T1021.004",
     "SSH-based lateral movement detected",
     ("ssh.*-i.*key|ssh.*@.*root|sshpass", "paramiko.*connect",)),
    ("admin_share_access", "HIGH", 25, "Lateral Movement", "T1021.002",
     "Administrative share access for lateral movement",
     (r"net use.*ADMIN\$|net use.*C\$|net use.*IPC\$", "Map.*admin.*share",)),
    # C2
    ("command_and_control", "CRITICAL", 50, "C2", "T1219",
     "Known C2 framework artifact detected",
     (r"\bcobalt\b|\bcobalt strike\b", r"\bmeterpreter\b", r"\bsliver\b", r"\bhavoc\b",)),
    ("dns_tunneling", "CRITICAL", 45, "C2", "T1071.004",
     "DNS tunneling or covert channel detected",
     ("dns (tunnel|exfil|c2)|iodine|dnscat", "TXT.*base64", "long.*subdomain.*query",)),
    ("beacon_pattern", "HIGH", 40, "C2", "T1071.001",
     "Beaconing behavior detected",
     ("periodic.*request|beacon interval|check.?in.*interval",)),
    ("tor_usage", "HIGH", 30, "C2", "T1090.003",
     "Tor network usage detected",
     (r"\.onion|tor (browser|exit|relay|node)", "9050|9051|9150",)),
    ("reverse_shell", "CRITICAL", 50, "C2", "T1059",
     "Reverse shell command detected",
     (r"bash -i.*>&|nc.*-e|python.*socket.*connect|\/dev\/tcp\/",)),
    ("http_c2_pattern", "CRITICAL", 45, "C2", "T1071.001",
     "HTTP-based C2 communication pattern detected",
     (r"POST.*\/beacon|POST.*\/submit\.php|POST.*\/gate\.php", "User-Agent.*(MSIE 6|wget|curl).*(C2|callback)",)),
    ("icmp_tunnel", "HIGH", 35, "C2", "T1095",
     "ICMP tunneling for covert C2 channel",
     ("icmp.*tunnel|ping.*tunnel|icmpsh|ptunnel", "ICMP.*payload.*data",)),
    ("domain_fronting", "CRITICAL", 40, "C2", "T1090.004",
     "Domain fronting for C2 evasion detected",
     ("domain.*front|CDN.*proxy.*C2|cloudfront.*redirect", "Host:.*mismatch.*SNI",)),
    ("fast_flux_dns", "HIGH", 30, "C2", "T1568.001",
     "Fast-flux DNS technique detected",
     ("fast.?flux|rapid.*DNS.*change|multiple.*A.*record.*rotation",)),
    # Exfiltration
    ("data_exfiltration", "HIGH", 35, "Exfiltration", "T1041",
     "Data exfiltration attempt detected",
     ("curl.*-T|wget.*--post-file", "exfil|data.?theft", r"large.*upload|upload.*\d{3,}MB",)),
    ("clipboard_exfil", "HIGH", 25, "Exfiltration", "T1115",
     "Clipboard data access for exfiltration",
     ("GetClipboardData|clipboard (dump|steal|monitor)",)),
    ("email_exfil", "HIGH", 30, "Exfiltration", "T1048.002",
     "Email-based exfiltration pattern",
     ("smtp.*attach|sendmail.*attachment", r"EventID[=: ]*4663.*\.pst",)),
    ("dns_exfiltration", "CRITICAL", 40, "Exfiltration", "T1048.003",
     "DNS-based data exfiltration detected",
     ("dns.*exfil|TXT.*encoded.*data|subdomain.*base64", "nslookup.*data.*encode",)),
    ("steganography_exfil", "HIGH", 30, "Exfiltration", "T1027.003",
     "Steganography-based exfiltration detected",
     ("steghide|stegano|openstego|data.*hidden.*image", "LSB.*embed|pixel.*encode",)),
    ("cloud_storage_exfil", "HIGH", 30, "Exfiltration", "T1567.002",
     "Cloud storage used for data exfiltration",
     ("rclone.*sync|rclone.*copy|mega.*upload", "dropbox.*upload|gdrive.*upload|aws s3 cp",)),
    # Defense Evasion
    ("log_tampering", "CRITICAL", 40, "Defense Evasion", "T1070.001",
     "Event log cleared - critical defense evasion indicator",
     ("EventID[=: ]*1102", "EventID[=: ]*104", "wevtutil.*cl", "Clear-EventLog",)),
    ("process_injection", "CRITICAL", 45, "Defense Evasion", "T1055",
     "Process injection technique detected",
     ("VirtualAllocEx|WriteProcessMemory|CreateRemoteThread", "process (inject|hollow|doppel)", "reflective dll",)),
    ("obfuscation", "HIGH", 30, "Defense Evasion", "T1027",
     "Command obfuscation detected (Base64/IEX)",
     ("base64.*-enc|frombase64string", r"iex\s*\(|invoke.?expression", r"char\(\d+\)\+char\(\d+\)",)),
    ("amsi_bypass", "CRITICAL", 40, "Defense Evasion", "T1562.001",
     "AMSI bypass attempt detected",
     ("amsi.*bypass|AmsiScanBuffer|AmsiInitFailed", "[Rr]ef.*Assembly.*AMSI",)),
    ("av_tamper", "CRITICAL", 40, "Defense Evasion", "T1562.001",
     "Antivirus/EDR tampering detected",
     ("(disable|stop|kill).*(antivirus|defender|av|edr)", "Set-MpPreference.*Disable",)),
    ("timestomp", "HIGH", 25, "Defense Evasion", "T1070.006",
     "Timestamp manipulation (timestomping) detected",
     ("timestomp|file.*timestamp.*(modif|manip|alter)", "SetFileTime",)),
    ("etw_bypass", "CRITICAL", 40, "Defense Evasion", "T1562.006",
     "ETW (Event Tracing for Windows) bypass detected",
     ("EtwEventWrite.*patch|ETW.*bypass|NtTraceControl", "etw.*disable.*provider",)),
    ("alternate_data_stream", "HIGH", 25, "Defense Evasion", "T1564.004",
     "Alternate Data Stream (ADS) used to hide data",
     (r"ADS.*stream|:.*\.exe|type.*>.*:.*stream", "alternate.*data.*stream|NTFS.*stream",)),
    ("binary_padding", "MEDIUM", 15, "Defense Evasion", "T1027.001",
     "Binary padding to evade hash-based detection",
     ("binary.*pad|file.*inflate|append.*null.*bytes", "signature.*evade.*size",)),
    ("disable_firewall", "CRITICAL", 35, "Defense Evasion", "T1562.004",
     "Host firewall disabled",
     ("netsh.*advfirewall.*off|netsh.*firewall.*disable", "Set-NetFirewallProfile.*-Enabled.*False|iptables.*-F",)),
    # Discovery
    ("network_scan", "MEDIUM", 15, "Discovery", "T1046",
     "Network scanning activity detected",
     (r"\bnmap\b|\bmassscan\b|\bzmap\b", "port.?scan|host.?discover", "SYN.*flood|ACK.*flood",)),
    ("ad_recon", "HIGH", 30, "Discovery", "T1087.002",
     "Active Directory reconnaissance detected",
     ("(BloodHound|SharpHound|ldapdomaindump)", "Get-ADUser|Get-ADComputer|Get-ADGroup", "LDAP.*search.*samaccountname",)),
    ("os_discovery", "LOW", 5, "Discovery", "T1082",
     "OS enumeration command detected",
     ("systeminfo|uname -a|cat /etc/os-release", r"winver|ver\b",)),
    ("user_enumeration", "LOW", 5, "Discovery", "T1087.001",
     "User and group enumeration detected",
     (r"net user\b|net localgroup|whoami /all|id\b", "Get-LocalUser|enum.*user",)),
    ("group_policy_discovery", "MEDIUM", 10, "Discovery", "T1615",
     "Group Policy discovery activity",
     ("gpresult|Get-GPO|Get-GPResultantSetOfPolicy", "group.?policy.*enum",)),
    ("security_software_discovery", "MEDIUM", 15, "Discovery", "T1518.001",
     "Security software enumeration detected",
     ("tasklist.*/svc.*security|Get-Process.*(defender|symantec|mcafee|kaspersky)", "WMIC.*AntiVirusProduct",)),
    ("network_share_discovery", "MEDIUM", 10, "Discovery", "T1135",
     "Network share enumeration detected",
     ("net share|net view|Get-SmbShare", "smbclient.*-L|enum4linux",)),
    # Credential Access
    ("credential_dumping", "CRITICAL", 50, "Credential Access", "T1003.001",
     "Credential dumping attempt (LSASS/Mimikatz)",
     (r"\bmimikatz\b|\blsadump\b|\bsekurlsa\b", "lsass.*(dump|access|procdump)", "EventID[=: ]*4663.*lsass",)),
    ("dcsync_attack", "CRITICAL", 55, "Credential Access", "T1003.006",
     "DCSync attack - replicating AD credentials",
     ("DCSync|DRS.*Replication|GetNCChanges", "lsadump::dcsync",)),
    ("sam_dump", "CRITICAL", 45, "Credential Access", "T1003.002",
     "SAM database credential dump detected",
     ("reg save.*SAM|reg save.*SECURITY|reg save.*SYSTEM", "secretsdump|samdump",)),
    ("ntds_dit_extraction", "CRITICAL", 55, "Credential Access", "T1003.003",
     "NTDS.dit extraction for offline credential dump",
     (r"ntds\.dit|ntdsutil.*snapshot|vssadmin.*shadow.*ntds", "esedbexport.*ntds",)),
    ("password_file_access", "HIGH", 20, "Credential Access", "T1552.001",
     "Password file access detected",
     (r"cat.*/etc/(passwd|shadow)|type.*\.password|findstr.*password", "credential.*file.*access",)),
    # Web Attack
    ("sql_injection", "HIGH", 15, "Web Attack", "T1190",
     "SQL Injection attempt detected",
     (r"union\s+select|OR\s+1=1|'; *DROP", r"SLEEP\(\d+\)|WAITFOR DELAY", r"xp_cmdshell|EXEC\s*\(",)),
    ("xss", "MEDIUM", 10, "Web Attack", "T1189",
     "Cross-Site Scripting (XSS) attempt detected",
     ("<script[^>]*>", "javascript:", r"onerror\s*=|onload\s*=", r"alert\s*\(.*\)",)),
    ("directory_traversal", "HIGH", 15, "Web Attack", "T1083",
     "Directory traversal attack detected",
     (r"\.\./\.\./", "%2e%2e%2f", r"\.\.\\\.\.\\", "/etc/passwd|/etc/shadow",)),
    ("lfi_rfi", "HIGH", 20, "Web Attack", "T1190",
     "Local/Remote File Inclusion attempt detected",
     ("(file|php|data|expect)://", "include.*http://", r"require.*\.\./",)),
    ("command_injection", "CRITICAL", 35, "Web Attack", "T1059",
     "OS Command Injection attempt detected",
     (r";\s*(ls|cat|id|whoami|wget|curl)\b", r"\|\s*(bash|sh|cmd|powershell)", "`(id|whoami|uname)`",)),
    ("ssrf", "HIGH", 25, "Web Attack", "T1190",
     "Server-Side Request Forgery (SSRF) attempt detected",
     (r"url=http://169\.254|url=http://127\.", r"metadata\.internal|169\.254\.169\.254",)),
    ("xxe", "HIGH", 25, "Web Attack", "T1190",
     "XML External Entity (XXE) injection detected",
     ("<!ENTITY.*SYSTEM|<!DOCTYPE.*ENTITY", "file:///",)),
    ("deserialization_attack", "CRITICAL", 40, "Web Attack", "T1190",
     "Insecure deserialization attack detected",
     (r"ysoserial|ObjectInputStream|readObject|unserialize\(", r"java\.lang\.Runtime.*exec",)),
    ("http_smuggling", "HIGH", 30, "Web Attack", "T1190",
     "HTTP request smuggling attempt detected",
     ("Transfer-Encoding.*chunked.*Content-Length|CL.*TE.*smuggl", "HTTP.*request.*smuggl",)),
    ("crlf_injection", "MEDIUM", 15, "Web Attack", "T1190",
     "CRLF injection attempt detected",
     (r"%0d%0a|\\r\\n.*inject|HTTP.*header.*inject", "CRLF.*inject",)),
    ("open_redirect", "MEDIUM", 10, "Web Attack", "T1190",
     "Open redirect vulnerability exploitation attempt",
     ("redirect.*=.*http|next=.*http|url=.*http|return.*=.*http", "open.*redirect.*vuln",)),
    # Malware
    ("ransomware", "CRITICAL", 60, "Malware", "T1486",
     "Ransomware activity indicators detected",
     (r"(encrypt|ransom|locked)\.(txt|html|note)", "YOUR_FILES_ARE_ENCRYPTED", r"\.locked$|\.crypt$|\.enc$",)),
    ("malware_download", "CRITICAL", 45, "Malware", "T1105",
     "Malware download mechanism detected",
     ("powershell.*DownloadString|powershell.*DownloadFile", "bitsadmin.*transfer", "certutil.*-decode|certutil.*-urlcache",)),
    ("worm_behavior", "CRITICAL", 40, "Malware", "T1080",
     "Worm-like propagation behavior detected",
     ("mass.?send|self.?replicate|propagat", r"net use.*\\.*\\ADMIN\$.*copy",)),
    ("fileless_malware", "CRITICAL", 50, "Malware", "T1059.001",
     "Fileless malware technique detected (LOLBins)",
     ("powershell.*-nop.*-w hidden|powershell.*-enc.*bypass", r"mshta.*vbscript|regsvr32.*\/s.*\/n.*\/u", r"wscript.*\/b|cscript.*\/b",)),
    ("macro_malware", "HIGH", 35, "Malware", "T1204.002",
     "Malicious macro document detected",
     ("macro.*download|VBA.*shell|Auto_Open.*exec", r"\.docm|\.xlsm.*malicious|macro.*enabled.*payload",)),
    ("webshell_detection", "CRITICAL", 50, "Malware", "T1505.003",
     "Web shell detected on server",
     ("webshell|web.?shell|c99|r57|b374k", r"cmd\.php|eval\s*\(\s*\$_(GET|POST|REQUEST)", "<%.*eval.*request",)),
    ("dropper_behavior", "CRITICAL", 40, "Malware", "T1105",
     "Malware dropper behavior detected",
     ("dropper|payload.*drop|stage[12].*download", r"Invoke-WebRequest.*-OutFile|iwr.*-o.*\.exe",)),
    # Auth Protocol Attack
    ("ntlm_downgrade", "HIGH", 20, "Auth Protocol Attack", "T1557.001",
     "NTLM downgrade attack detected",
     ("NTLM[- ]?V1|NTLMv1", "LM Hash",)),
    ("kerberoasting", "CRITICAL", 45, "Auth Protocol Attack", "T1558.003",
     "Kerberoasting attack detected",
     ("kerberoast|GetUserSPNs|TGS.*RC4|EventID[=: ]*4769.*RC4",)),
    ("golden_silver_ticket", "CRITICAL", 60, "Auth Protocol Attack", "T1558.001",
     "Golden/Silver Ticket Kerberos attack detected",
     ("golden ticket|silver ticket|forge.*TGT|EventID[=: ]*4768.*0x12",)),
    # Cloud Attack
    ("cloud_metadata_abuse", "CRITICAL", 40, "Cloud Attack", "T1552.005",
     "Cloud metadata service abuse attempt",
     (r"169\.254\.169\.254|metadata\.google\.internal", "iam/security-credentials|instance-identity/document",)),
    ("container_escape", "CRITICAL", 45, "Cloud Attack", "T1611",
     "Container escape attempt detected",
     ("docker.*privileged|--privileged", "container.*escape|nsenter|cgroup.*escape",)),
    # Supply Chain
    ("dependency_confusion", "CRITICAL", 50, "Supply Chain", "T1195.002",
     "Dependency confusion or package hijacking detected",
     ("dependency.*confusion|package.*hijack|typosquat.*package", "npm.*install.*malicious|pip.*install.*backdoor",)),
    ("typosquatting_package", "HIGH", 30, "Supply Chain", "T1195.002",
     "Package typosquatting attempt detected",
     ("typosquat|similar.*package.*name|impersonat.*package", "pypi.*typo|npm.*typo",)),
    ("build_pipeline_compromise", "CRITICAL", 50, "Supply Chain", "T1195.002",
     "Build pipeline or CI/CD compromise detected",
     ("CI/CD.*compromis|build.*pipeline.*inject|jenkins.*exploit", "github.*action.*malicious|gitlab.*runner.*abuse",)),
    # IoT/OT Attack
    ("scada_ics_abuse", "CRITICAL", 55, "IoT/OT Attack", "T0855",
     "SCADA/ICS protocol abuse detected",
     ("SCADA|Modbus|DNP3|OPC DA|ICS.*attack", "PLC.*(stop|start|reprogram|upload)", "S7comm|EtherNet/IP",)),
    ("modbus_exploit", "CRITICAL", 50, "IoT/OT Attack", "T0831",
     "Modbus protocol exploitation attempt",
     ("Modbus.*write.*coil|Modbus.*function.*code.*(5|6|15|16)", "modbus.*brute|modbus.*scan",)),
    ("mqtt_anomaly", "HIGH", 30, "IoT/OT Attack", "T0883",
     "MQTT protocol anomaly detected",
     ("MQTT.*(inject|exploit|abuse)|mosquitto.*unauth", "MQTT.*subscribe.*#|MQTT.*wildcard",)),
    # Insider Threat
    ("mass_file_access", "HIGH", 30, "Insider Threat", "T1005",
     "Mass file access pattern detected - possible insider data collection",
     ("mass.*file.*(access|read|copy)|bulk.*file.*operation", r"EventID[=: ]*4663.*Count.*[5-9]\d{2,}",)),
    ("off_hours_access", "MEDIUM", 15, "Insider Threat", "T1078",
     "Off-hours system access detected",
     (r"(0[0-4]):\d{2}:\d{2}.*logon|after.?hours.*access", "weekend.*login.*critical",)),
    ("bulk_download", "HIGH", 30, "Insider Threat", "T1530",
     "Bulk data download detected",
     ("bulk.*download|mass.*download|wget.*-r.*mirror", r"download.*(\d{3,})\s*(files|documents|records)",)),
    ("usb_exfil", "HIGH", 25, "Insider Threat", "T1052.001",
     "USB storage device used - potential data exfiltration via removable media",
     ("USB.*mass.*storage|removable.*media.*write|EventID[=: ]*6416", "USBSTOR.*insert",)),
    # Zero-Day/Exploit
    ("exploit_kit", "CRITICAL", 50, "Zero-Day/Exploit", "T1203",
     "Exploit kit activity detected",
     ("exploit.?kit|RIG.*EK|Magnitude.*EK|Fallout.*EK", "landing.*page.*redirect.*exploit",)),
    ("shellcode_detect", "CRITICAL", 50, "Zero-Day/Exploit", "T1203",
     "Shellcode or payload generation detected",
     (r"shellcode|NOP.*sled|\\x90{4,}|egg.*hunter", "payload.*generate.*msfvenom",)),
    ("heap_spray", "CRITICAL", 45, "Zero-Day/Exploit", "T1203",
     "Heap spray attack technique detected",
     ("heap.*spray|spray.*heap|0x0c0c0c0c|0x41414141{4,}", "javascript.*unescape.*spray",)),
    ("rop_chain", "CRITICAL", 45, "Zero-Day/Exploit", "T1203",
     "ROP chain exploitation technique detected",
     ("ROP.*chain|return.*oriented.*program|gadget.*chain", "stack.*pivot|ret2libc",)),
    # Email/Phishing
    ("phishing_url", "HIGH", 25, "Email/Phishing", "T1566.002",
     "Phishing URL or campaign detected",
     ("phishing|phish.*url|credential.*harvest.*url", "login.*fake|signin.*spoof|account.*verify.*link",)),
    ("macro_document", "HIGH", 30, "Email/Phishing", "T1566.001",
     "Macro-enabled document delivery detected",
     (r"\.docm|\.xlsm|\.pptm|macro.*enabled", "VBA.*AutoOpen|Document_Open|Workbook_Open",)),
    ("spoofed_sender", "HIGH", 25, "Email/Phishing", "T1566.001",
     "Email sender spoofing detected",
     ("spoof.*sender|forged.*from|SPF.*fail.*spoof", "DMARC.*fail|DKIM.*mismatch",)),
    ("credential_harvest", "CRITICAL", 40, "Email/Phishing", "T1566.003",
     "Credential harvesting infrastructure detected",
     ("credential.*harvest|fake.*login.*page|evilginx|gophish", "modlishka|king.*phisher",)),
    # Cryptomining
    ("mining_pool", "HIGH", 25, "Cryptomining", "T1496",
     "Cryptocurrency mining pool connection detected",
     (r"mining.*pool|stratum\+tcp|pool\.(minergate|hashvault|nanopool)", "monero.*pool|bitcoin.*pool|crypto.*mine.*connect",)),
    ("stratum_protocol", "HIGH", 30, "Cryptomining", "T1496",
     "Stratum mining protocol communication detected",
     (r"stratum.*subscribe|mining\.submit|mining\.authorize", "eth_submitWork|eth_getWork",)),
    ("xmrig_detect", "HIGH", 30, "Cryptomining", "T1496",
     "Cryptocurrency miner executable detected (XMRig/CPUMiner)",
     (r"xmrig|xmr-stak|cpuminer|minerd\b", "randomx.*init|cryptonight.*hash",)),
    # API Security
    ("jwt_abuse", "HIGH", 25, "API Security", "T1190",
     "JWT token abuse or algorithm confusion attack",
     ("JWT.*tamper|jwt.*none.*algorithm|alg.*none", r"eyJ[a-zA-Z0-9_-]*\.eyJ.*forged",)),
    ("api_key_exposure", "HIGH", 20, "API Security", "T1552.001",
     "API key exposure or leakage detected",
     ("api[_-]?key[=: ]+[a-zA-Z0-9]{20,}", "Authorization.*Bearer.*leak|x-api-key.*expos",)),
    ("graphql_injection", "HIGH", 25, "API Security", "T1190",
     "GraphQL introspection or injection attack",
     ("__schema|__type|IntrospectionQuery", "graphql.*inject|mutation.*unauthorized",)),
    ("rate_limit_bypass", "MEDIUM", 15, "API Security", "T1190",
     "API rate limiting bypass attempt",
     ("rate.?limit.*bypass|X-Forwarded-For.*spoof.*rate", "429.*bypass|throttle.*evade",)),
    ("api_mass_assignment", "HIGH", 25, "API Security", "T1190",
     "API mass assignment or prototype pollution attack",
     ("mass.?assign|parameter.*pollut|prototype.*pollut", "__proto__.*inject|constructor.*pollut",)),
    ("broken_auth_api", "HIGH", 25, "API Security", "T1190",
     "Broken Object Level Authorization (BOLA/IDOR) attempt",
     ("IDOR|insecure.*direct.*object|BOLA|broken.*object.*level", "unauthorized.*api.*access",)),
    ("oauth_token_theft", "CRITICAL", 35, "API Security", "T1528",
     "OAuth token theft or authorization code interception",
     ("oauth.*redirect.*steal|authorization_code.*intercept", "token.*hijack.*oauth|oauth.*phish",)),
    # AI/ML Attack
    ("prompt_injection", "HIGH", 25, "AI/ML Attack", "T1190",
     "AI prompt injection or jailbreak attempt",
     ("prompt.*inject|ignore.*previous.*instruct|DAN.*mode", "jailbreak.*prompt|system.*prompt.*leak",)),
    ("model_poisoning", "CRITICAL", 40, "AI/ML Attack", "T1195.002",
     "ML model poisoning or backdoor injection",
     ("model.*poison|training.*data.*tamper|adversarial.*train", "backdoor.*model|trojan.*neural",)),
    ("adversarial_input", "HIGH", 25, "AI/ML Attack", "T1190",
     "Adversarial input attack against ML model",
     ("adversarial.*example|evasion.*attack.*model|perturbation.*input", "model.*evasion|classifier.*bypass",)),
    ("data_extraction_llm", "HIGH", 30, "AI/ML Attack", "T1005",
     "Data extraction attack against language model",
     ("training.*data.*extract|model.*inversion|membership.*inference", "PII.*extract.*model|memorization.*attack",)),
    # Blockchain Attack
    ("smart_contract_exploit", "CRITICAL", 40, "Blockchain Attack", "T1190",
     "Smart contract exploitation attempt",
     ("reentrancy.*attack|flash.?loan.*exploit|front.?run.*MEV", "smart.*contract.*vuln|solidity.*overflow",)),
    ("wallet_theft", "CRITICAL", 45, "Blockchain Attack", "T1005",
     "Cryptocurrency wallet theft or draining attack",
     ("wallet.*drain|private.*key.*steal|seed.*phrase.*exfil", "metamask.*phish|crypto.*wallet.*compromise",)),
    ("crypto_rug_pull", "HIGH", 30, "Blockchain Attack", "T1190",
     "Cryptocurrency rug pull or exit scam indicators",
     ("rug.*pull|liquidity.*drain|exit.*scam.*token", "honeypot.*token|pump.*dump.*scheme",)),
    ("crypto_clipper", "CRITICAL", 40, "Blockchain Attack", "T1115",
     "Crypto clipboard hijacker (address swapper) detected",
     ("clipboard.*replace.*wallet|address.*swap.*crypto", "clipper.*malware|BTC.*address.*hijack",)),
    # Network Attack
    ("arp_poisoning", "HIGH", 30, "Network Attack", "T1557",
     "ARP spoofing/poisoning attack detected",
     ("ARP.*spoof|ARP.*poison|arp.*cache.*tamper", "ettercap|arpspoof|bettercap.*arp",)),
    ("dns_rebinding", "HIGH", 30, "Network Attack", "T1557",
     "DNS rebinding attack detected",
     ("DNS.*rebind|rebinding.*attack|DNS.*pinning.*bypass", "time-of-check.*DNS|TOCTOU.*DNS",)),
    ("bgp_hijacking", "CRITICAL", 50, "Network Attack", "T1557",
     "BGP route hijacking or prefix manipulation",
     ("BGP.*hijack|route.*leak|AS.*path.*manipulat", "prefix.*hijack|BGP.*anomal",)),
    ("vlan_hopping", "HIGH", 25, "Network Attack", "T1599",
     "VLAN hopping attack detected",
     (r"VLAN.*hop|802\.1Q.*double.*tag|DTP.*attack", "trunk.*negotiat.*attack|switch.*spoof",)),
    ("ssl_stripping", "HIGH", 30, "Network Attack", "T1557.002",
     "SSL/TLS stripping or downgrade attack",
     ("SSL.*strip|HTTPS.*downgrade|sslstrip|HSTS.*bypass", "certificate.*spoof|MitM.*TLS",)),
    ("wifi_attack", "HIGH", 25, "Network Attack", "T1557",
     "Wireless network attack detected",
     ("deauth.*attack|evil.*twin|karma.*attack|PMKID.*crack", "WPA.*crack|aircrack|handshake.*capture",)),
    # Zero Trust Bypass
    ("mfa_fatigue", "CRITICAL", 35, "Zero Trust Bypass", "T1621",
     "MFA fatigue/push spam attack detected",
     ("MFA.*fatigue|push.*spam|MFA.*bomb|MFA.*flood", "repeated.*auth.*push|2FA.*bypass.*fatigue",)),
    ("session_fixation", "HIGH", 25, "Zero Trust Bypass", "T1550",
     "Session fixation attack detected",
     ("session.*fixat|session.*id.*inject|pre-set.*session", "JSESSIONID.*manipulat|cookie.*fixat",)),
    ("saml_attack", "CRITICAL", 45, "Zero Trust Bypass", "T1606.002",
     "SAML token forgery or injection attack",
     ("SAML.*forge|SAML.*inject|XML.*signature.*wrap", "golden.*SAML|SAML.*response.*tamper",)),
    ("conditional_access_bypass", "HIGH", 30, "Zero Trust Bypass", "T1556",
     "Conditional access policy bypass attempt",
     ("conditional.*access.*bypass|device.*compliance.*spoof", "trusted.*location.*spoof|Azure.*AD.*bypass",)),
    ("kerberos_delegation_abuse", "CRITICAL", 40, "Zero Trust Bypass", "T1558",
     "Kerberos delegation abuse for privilege escalation",
     ("unconstrained.*delegation|constrained.*delegation.*abuse", "S4U2Self|S4U2Proxy|resource.*based.*delegation",)),
    ("password_spraying_cloud", "HIGH", 25, "Zero Trust Bypass", "T1110.003",
     "Cloud password spraying attack detected",
     ("password.*spray.*azure|password.*spray.*O365|spray.*cloud.*auth", "AADSTS50126.*multiple|cloud.*brute.*force",)),
)
