"""Patterns of the regular-expression rules, in ECMAScript syntax; ``functions.regex`` turns them into Java's."""

from __future__ import annotations

# Rule id, name, severity, flags in force, languages (empty: all), pattern.

INJECTION = (
    ("INJ-01", "String Concatenation SQL", "high", "i", "js,ts", r"""(?:query|execute|sql)\s*\(\s*['"`](?:SELECT|INSERT|UPDATE|DELETE).*\+.*(?:req\.|params\.|body\.|query\.)"""),
    ("INJ-02", "Template Literal SQL", "high", "i", "js,ts", r"""(?:query|execute|sql)\s*\(\s*`(?:SELECT|INSERT|UPDATE|DELETE)[^`]*\$\{[^}]+\}"""),
    ("INJ-03", "Python f-string SQL", "high", "i", "py", r"""(?:execute|cursor\.execute)\s*\(\s*f['"](?:SELECT|INSERT|UPDATE|DELETE)[^'"]*\{[^}]+\}"""),
    ("INJ-04", "Python format SQL", "high", "i", "py", r"""(?:execute|cursor\.execute)\s*\(\s*['"](?:SELECT|INSERT|UPDATE|DELETE)[^'"]*['"]\.format\s*\("""),
    ("INJ-05", "Python % formatting SQL", "high", "i", "py", r"""(?:execute|cursor\.execute)\s*\(\s*['"](?:SELECT|INSERT|UPDATE|DELETE)[^'"]*%s[^'"]*['"].*%"""),
    ("INJ-06", "Java String Concat SQL", "high", "i", "java", r"""(?:executeQuery|executeUpdate|prepareStatement)\s*\(\s*['"](?:SELECT|INSERT|UPDATE|DELETE)[^'"]*['"]\s*\+"""),
    ("INJ-07", "Raw SQL with Variable", "high", "i", "js,ts,py,java,go", r"""['"`](?:SELECT|INSERT|UPDATE|DELETE)\s+.+(?:WHERE|VALUES|SET)\s+.+['"`]\s*\+\s*\w+"""),
    ("INJ-08", "MongoDB Injection", "high", "i", "js,ts", r"""(?:find|findOne|updateOne|deleteOne)\s*\(\s*\{[^}]*:\s*(?:req\.|params\.|body\.|query\.)"""),
    ("INJ-09", "Command Injection", "critical", "i", "js,ts,py", r"""(?:exec|spawn|execSync|spawnSync|system|popen)\s*\([^)]*(?:req\.|params\.|body\.|query\.|input)"""),
)

XSS = (
    ("XSS-01", "dangerouslySetInnerHTML", "medium", "i", "js,ts", r"""dangerouslySetInnerHTML\s*=\s*\{\s*\{\s*__html\s*:\s*(?!.*sanitize|.*DOMPurify|.*escape)"""),
    ("XSS-02", "innerHTML Assignment", "high", "i", "js,ts", r"""\.innerHTML\s*=\s*(?!['"`]<)"""),
    ("XSS-03", "outerHTML Assignment", "medium", "i", "js,ts", r"""\.outerHTML\s*=\s*(?!['"`]<)"""),
    ("XSS-04", "document.write", "medium", "i", "js,ts", r"""document\.write\s*\("""),
    ("XSS-05", "jQuery html()", "high", "i", "js,ts", r"""\$\([^)]+\)\.html\s*\(\s*(?!['"`]<)"""),
    ("XSS-06", "jQuery append with variable", "medium", "i", "js,ts", r"""\$\([^)]+\)\.(?:append|prepend|after|before)\s*\(\s*(?:['"`]\s*<[^>]+>\s*['"`]\s*\+|\$\s*\()"""),
    ("XSS-07", "Vue v-html", "high", "i", "js,ts", r"""v-html\s*=\s*['"][^'"]+['"]"""),
    ("XSS-08", "Angular bypassSecurityTrust", "medium", "i", "ts", r"""bypassSecurityTrust(?:Html|Script|Style|Url|ResourceUrl)"""),
    ("XSS-09", "Flask Markup/safe", "medium", "i", "py", r"""Markup\s*\(|mark_safe\s*\(|\|safe\b"""),
    ("XSS-10", "Jinja autoescape off", "medium", "i", "py", r"""\{%\s*autoescape\s+false\s*%\}"""),
    ("XSS-11", "JSP Expression", "medium", "i", "java", r"""<%=\s*(?:request|session)\."""),
    ("XSS-12", "javascript: URL", "medium", "i", "js,ts,py,java", r"""href\s*=\s*['"`]javascript:"""),
    ("XSS-13", "eval() Usage", "critical", "i", "js,ts", r"""\beval\s*\("""),
    ("XSS-14", "new Function()", "critical", "i", "js,ts", r"""new\s+Function\s*\("""),
)

CRYPTO = (
    ("CRY-01", "Weak Hash (MD5)", "high", "i", "", r"""createHash\s*\(\s*['"]md5['"]\s*\)"""),
    ("CRY-02", "Weak Hash (SHA1)", "medium", "i", "", r"""createHash\s*\(\s*['"]sha1?['"]\s*\)"""),
    ("CRY-03", "Insecure Random (Math.random)", "medium", "", "", r"""Math\.random\s*\(\s*\)"""),
    ("CRY-04", "Insecure Random (Python)", "medium", "", "", r"""\brandom\.(random|randint|choice|shuffle)\s*\("""),
    ("CRY-05", "Hardcoded Encryption Key", "critical", "i", "", r"""(?:encryption[_-]?key|secret[_-]?key|aes[_-]?key)\s*[=:]\s*['"][A-Za-z0-9+/=]{16,}['"]"""),
    ("CRY-06", "Hardcoded IV", "high", "i", "", r"""\biv\s*[=:]\s*['"][A-Fa-f0-9]{32}['"]"""),
    ("CRY-07", "Hardcoded Salt", "high", "i", "", r"""\bsalt\s*[=:]\s*['"][A-Za-z0-9+/=]{8,}['"]"""),
    ("CRY-08", "ECB Mode Encryption", "high", "i", "", r"""(?:aes|des)[_-]?(?:128|192|256)?[_-]?ecb"""),
    ("CRY-09", "DES Encryption", "high", "i", "", r"""(?:createCipher|createDecipher)\s*\(\s*['"]des(?:-ede3)?['"]"""),
    ("CRY-10", "Disabled SSL Verification", "critical", "i", "", r"""rejectUnauthorized\s*:\s*false|verify\s*[=:]\s*false|CERT_NONE"""),
    ("CRY-11", "Insecure TLS Version", "high", "i", "", r"""(?:TLSv1|SSLv3|TLS_v1_0|TLS_v1_1)(?!_2|_3)"""),
    ("CRY-12", "Plain Password Storage", "high", "i", "", r"""password\s*[=:]\s*(?:req\.body|request\.|params\.|input)"""),
    ("CRY-13", "Timing Attack Vulnerable Comparison", "medium", "i", "", r"""password\s*===?\s*(?:stored|db|user)\."""),
)

AUTH = (
    ("AUT-01", "JWT No Algorithm Verification", "critical", "i", "", r"""algorithms?\s*:\s*\[\s*['"]none['"]"""),
    ("AUT-02", "JWT Secret in Code", "critical", "i", "", r"""jwt\.sign\s*\([^,]+,\s*['"][^'"]{8,}['"]"""),
    ("AUT-03", "JWT No Expiration", "medium", "i", "", r"""jwt\.sign\s*\([^)]+\)\s*(?!.*expiresIn)"""),
    ("AUT-04", "JWT Verify Without Options", "medium", "i", "", r"""jwt\.verify\s*\(\s*\w+\s*,\s*\w+\s*\)(?!\s*,)"""),
    ("AUT-05", "Session Secret in Code", "high", "i", "", r"""session\s*\(\s*\{[^}]*secret\s*:\s*['"][^'"]+['"]"""),
    ("AUT-06", "Cookie Without HttpOnly", "medium", "i", "", r"""cookie\s*\(\s*['"][^'"]+['"]\s*,\s*[^)]*(?!httpOnly)"""),
    ("AUT-07", "Cookie Without Secure", "medium", "i", "", r"""cookie.*secure\s*:\s*false"""),
    ("AUT-08", "Cookie SameSite None", "medium", "i", "", r"""sameSite\s*:\s*['"]?none['"]?"""),
    ("AUT-09", "CORS Allow All Origins", "high", "i", "", r"""(?:Access-Control-Allow-Origin|origin)\s*[=:]\s*['"]?\*['"]?"""),
    ("AUT-10", "CORS Credentials with Wildcard", "critical", "i", "", r"""credentials\s*:\s*true.*origin\s*:\s*['"]?\*|origin\s*:\s*['"]?\*.*credentials\s*:\s*true"""),
    ("AUT-11", "Weak Password Validation", "medium", "i", "", r"""password\.length\s*[<>=]+\s*[1-6]\b"""),
    ("AUT-12", "Authentication Bypass Risk", "low", "i", "", r"""if\s*\(\s*(?:!user|user\s*==\s*null|!req\.user|!session)"""),
    ("AUT-13", "Hardcoded Credentials", "high", "i", "", r"""(?:admin|root|administrator)\s*[=:]\s*['"][^'"]+['"]"""),
    ("AUT-14", "OAuth State Missing", "medium", "i", "", r"""oauth.*redirect(?!.*state)"""),
    ("AUT-15", "2FA Bypass Risk", "high", "i", "", r"""(?:skip|bypass|disable).*(?:2fa|mfa|two.?factor)"""),
)

PATH = (
    ("PTH-01", "Path Traversal Risk", "critical", "i", "", r"""(?:readFile|writeFile|unlink|rmdir|mkdir|access|stat|createReadStream|createWriteStream)\s*\(\s*(?:req\.|params\.|body\.|query\.|input)"""),
    ("PTH-02", "Path Traversal (Path Join)", "high", "i", "", r"""path\.join\s*\([^,]+,\s*(?:req\.|params\.|body\.|query\.)"""),
    ("PTH-03", "Path Traversal Pattern", "medium", "", "", r"""\.\.[/\\]"""),
    ("PTH-04", "Dangerous File Delete", "critical", "i", "", r"""(?:unlink|rmdir|rm|remove).*(?:req\.|params\.|body\.|query\.)"""),
    ("PTH-05", "Recursive Delete", "high", "i", "", r"""rm\s*\(\s*[^,]+,\s*\{\s*recursive\s*:\s*true"""),
    ("PTH-06", "Unsafe File Upload", "medium", "i", "", r"""(?:originalname|filename|name)\s*(?:\.split|\.slice|\.substring)"""),
    ("PTH-07", "Missing File Type Validation", "medium", "i", "", r"""multer|upload|formidable|busboy(?!.*mimetype|.*fileFilter)"""),
    ("PTH-08", "Executable Upload Risk", "high", "i", "", r"""\.(exe|sh|bat|cmd|ps1|php|jsp|asp|py|rb|pl)\b.*upload"""),
    ("PTH-09", "Hardcoded Temp Path", "low", "i", "", r"""['"]/tmp/|['"]C:\\Temp\\"""),
    ("PTH-10", "Predictable Temp Filename", "medium", "i", "", r"""/tmp/[a-zA-Z_]+\.(txt|log|tmp)"""),
    ("PTH-11", "Symlink Following Risk", "low", "i", "", r"""(?:readFile|createReadStream)\s*\([^)]+\)(?!.*lstat)"""),
    ("PTH-12", "Directory Listing", "medium", "i", "", r"""(?:readdir|readdirSync)\s*\(\s*(?:req\.|params\.|body\.|query\.)"""),
    ("PTH-13", "Overly Permissive Mode", "high", "i", "", r"""chmod.*(?:0?777|0?666)|mode\s*:\s*(?:0?777|0?666)"""),
    ("PTH-14", "Python Open with User Input", "high", "i", "", r"""open\s*\(\s*(?:request\.|args\.|input\()"""),
    ("PTH-15", "Python Pickle Deserialization", "critical", "i", "", r"""pickle\.load|cPickle\.load|joblib\.load"""),
    ("PTH-16", "Java Zip Slip", "high", "i", "", r"""ZipEntry.*getName\s*\(\s*\)"""),
    ("PTH-17", "Java File with User Input", "high", "i", "", r"""new\s+File\s*\(\s*(?:request\.|params\.|input)"""),
)

DOCKERFILE = (
    ("DF001", "", "medium", "m", "", r"""^FROM\s+[^:]+$"""),
    ("DF002", "", "high", "m", "", r"""^USER\s+root\b"""),
    ("DF003", "", "high", "m", "", r"""^(?!.*USER\s+(?!root))"""),
    ("DF004", "", "critical", "m", "", r"""EXPOSE\s+22\b"""),
    ("DF005", "", "low", "m", "", r"""apt-get\s+install(?!.*--no-install-recommends)"""),
    ("DF006", "", "critical", "m", "", r"""curl.*\|\s*(?:bash|sh)"""),
    ("DF007", "", "low", "m", "", r"""COPY\s+--chown=\d+:\d+"""),
    ("DF008", "", "medium", "m", "", r"""ADD\s+https?://"""),
    ("DF009", "", "low", "m", "", r"""apk\s+add(?!.*--no-cache)"""),
    ("DF010", "", "medium", "m", "", r"""(?:apt-get|apk|yum)\s+(?:update|upgrade)(?!.*&&)"""),
    ("DF011", "", "medium", "m", "", r"""HEALTHCHECK\s+NONE"""),
    ("DF012", "", "low", "m", "", r"""^(?!.*HEALTHCHECK)"""),
    ("DF013", "", "critical", "m", "", r"""ENV\s+(?:PASSWORD|SECRET|TOKEN|API_KEY)\s*=\s*\S+"""),
    ("DF014", "", "high", "m", "", r"""chmod\s+777"""),
    ("DF015", "", "medium", "m", "", r"""wget.*(?!--secure-protocol)"""),
)

TERRAFORM = (
    ("TF001", "", "high", "s", "", r"""resource\s+"aws_security_group"[^}]*ingress\s*\{[^}]*cidr_blocks\s*=\s*\[\s*"0\.0\.0\.0/0"\s*\]"""),
    ("TF002", "", "critical", "s", "", r'''resource\s+"aws_s3_bucket"[^}]*acl\s*=\s*"public-read"'''),
    ("TF003", "", "critical", "s", "", r"""resource\s+"aws_db_instance"[^}]*publicly_accessible\s*=\s*true"""),
    ("TF004", "", "medium", "s", "", r"""resource\s+"aws_instance"[^}]*associate_public_ip_address\s*=\s*true"""),
    ("TF005", "", "high", "s", "", r"""resource\s+"aws_s3_bucket"(?![^}]*server_side_encryption_configuration)"""),
    ("TF006", "", "high", "s", "", r"""resource\s+"aws_db_instance"(?![^}]*storage_encrypted\s*=\s*true)"""),
    ("TF007", "", "critical", "s", "", r'''(?:password|secret|token|api_key)\s*=\s*"[^"]{8,}"'''),
    ("TF008", "", "critical", "s", "", r'''access_key\s*=\s*"AKIA[A-Z0-9]{16}"'''),
    ("TF009", "", "medium", "s", "", r"""resource\s+"aws_s3_bucket"(?![^}]*logging\s*\{)"""),
    ("TF010", "", "high", "s", "", r"""resource\s+"aws_cloudtrail"[^}]*enable_logging\s*=\s*false"""),
    ("TF011", "", "high", "s", "", r"""resource\s+"google_compute_firewall"[^}]*source_ranges\s*=\s*\[\s*"0\.0\.0\.0/0"\s*\]"""),
    ("TF012", "", "medium", "s", "", r"""resource\s+"google_storage_bucket"[^}]*uniform_bucket_level_access\s*=\s*false"""),
    ("TF013", "", "high", "s", "", r'''resource\s+"azurerm_network_security_rule"[^}]*source_address_prefix\s*=\s*"\*"'''),
    ("TF014", "", "medium", "s", "", r'''enable_http\s*=\s*true|protocol\s*=\s*"HTTP"'''),
    ("TF015", "", "high", "s", "", r'''min_tls_version\s*=\s*"1\.[01]"|ssl_policy\s*=\s*".*TLSv1[^_2]"'''),
)
