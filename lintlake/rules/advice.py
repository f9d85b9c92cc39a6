"""What a finding of each rule says: what is wrong, and what to do about it."""

from __future__ import annotations

ADVICE = {
    "INJ-01": ("A query is put together from strings and request data.", "Pass the values as parameters of a prepared statement."),
    "INJ-02": ("A query is a template literal with values in it.", "Use placeholders and hand the values over separately."),
    "INJ-03": ("A query is an f-string with values in it.", "Give execute() the query with placeholders and a tuple of values."),
    "INJ-04": ("A query is filled in by format().", "Give execute() the query with placeholders and a tuple of values."),
    "INJ-05": ("A query is filled in by the % operator.", "Leave %s to the driver: pass the values as a second argument."),
    "INJ-06": ("A statement is built by adding strings.", "Use PreparedStatement with question marks and setters."),
    "INJ-07": ("Raw SQL is joined with a variable.", "Bind the variable as a parameter, or use a query builder."),
    "INJ-08": ("A MongoDB filter takes its value from the request as it is.", "Cast the value to a plain string and reject operators."),
    "INJ-09": ("A command line contains request data.", "Run the program with a fixed name and an argument list, without a shell."),
    "XSS-01": ("Markup is set from a value that nothing cleans.", "Clean the value with a sanitizer, or render it as text."),
    "XSS-02": ("innerHTML is set from a value.", "Set textContent, or clean the markup first."),
    "XSS-03": ("outerHTML is set from a value.", "Build the element and replace the old node with it."),
    "XSS-04": ("document.write puts strings into the page.", "Create nodes and append them."),
    "XSS-05": ("jQuery's html() shows a value as markup.", "Use text(), or clean the value."),
    "XSS-06": ("jQuery appends markup built from parts.", "Build the element and set its text."),
    "XSS-07": ("v-html shows a value as markup.", "Use interpolation, or clean the value before it is bound."),
    "XSS-08": ("Angular's own cleaning is switched off for a value.", "Let Angular clean it, and trust constants only."),
    "XSS-09": ("A template value is marked as safe.", "Leave automatic escaping on for everything a user can set."),
    "XSS-10": ("Automatic escaping is off in a template block.", "Remove the block, and escape by default."),
    "XSS-11": ("A JSP expression prints request or session data.", "Print through c:out or fn:escapeXml."),
    "XSS-12": ("A link runs script.", "Link to an address, and attach a handler for actions."),
    "XSS-13": ("eval() runs a string as code.", "Parse data with JSON.parse, and call functions by name."),
    "XSS-14": ("new Function() compiles a string.", "Write the function out, or look it up in a table."),
    "CRY-01": ("MD5 collisions are cheap.", "Use SHA-256, or a password hash for passwords."),
    "CRY-02": ("SHA-1 collisions are practical.", "Use SHA-256 or SHA-3."),
    "CRY-03": ("Math.random() can be predicted.", "Use crypto.randomBytes or crypto.getRandomValues."),
    "CRY-04": ("The random module can be predicted.", "Use the secrets module."),
    "CRY-05": ("An encryption key is part of the code.", "Load the key from a vault and rotate it."),
    "CRY-06": ("An initialisation vector is a constant.", "Draw a new random vector for every message."),
    "CRY-07": ("A salt is a constant.", "Draw a random salt for every password."),
    "CRY-08": ("ECB mode shows equal blocks as equal.", "Use an authenticated mode such as GCM."),
    "CRY-09": ("DES keys are too short.", "Use AES-256 in an authenticated mode."),
    "CRY-10": ("Certificates are not checked.", "Leave checking on, and add your own authority to the trusted ones."),
    "CRY-11": ("An outdated TLS or SSL version is named.", "Require TLS 1.2 or later."),
    "CRY-12": ("A password is kept as it was entered.", "Store a salted hash made by bcrypt or argon2."),
    "CRY-13": ("Comparing secrets with === leaks timing.", "Compare with crypto.timingSafeEqual."),
    "AUT-01": ("Tokens without a signature are accepted.", "Allow only the algorithms that you sign with."),
    "AUT-02": ("The token secret is part of the code.", "Read the secret from the environment or a vault."),
    "AUT-03": ("A token is signed without an expiry on the same line.", "Set expiresIn to minutes or hours."),
    "AUT-04": ("A token is verified without options.", "Name the algorithms, the issuer and the audience."),
    "AUT-05": ("The session secret is part of the code.", "Read it from the environment and rotate it."),
    "AUT-06": ("A cookie may be readable from scripts.", "Set httpOnly."),
    "AUT-07": ("A cookie travels over plain HTTP.", "Set secure to true."),
    "AUT-08": ("A cookie goes along with requests of other sites.", "Use sameSite lax or strict."),
    "AUT-09": ("Every origin may read responses.", "List the origins that may."),
    "AUT-10": ("Credentials are allowed for every origin.", "Name the origins where credentials are allowed."),
    "AUT-11": ("Very short passwords are accepted.", "Ask for 8 characters at least, better 12."),
    "AUT-12": ("A missing user is handled by a single condition.", "Refuse by default in one place for all routes."),
    "AUT-13": ("A privileged account has its credential in the code.", "Move it to a vault and change it."),
    "AUT-14": ("A redirect of the login flow carries no state.", "Send a random state and compare it on return."),
    "AUT-15": ("A second factor can be skipped.", "Remove the way around, and log every exception."),
    "PTH-01": ("A file is opened by a name from the request.", "Resolve the name below a fixed folder and check the result."),
    "PTH-02": ("A path is joined with request data.", "Take the base name only, then check the resolved path."),
    "PTH-03": ("A path goes up from its folder.", "Use absolute paths from configuration."),
    "PTH-04": ("What is deleted depends on the request.", "Look the file up by an id that belongs to the user."),
    "PTH-05": ("A whole tree is deleted.", "Check the folder against a fixed list first."),
    "PTH-06": ("The client's file name is taken apart and used.", "Name uploads yourself, by a random id."),
    "PTH-07": ("Uploads are handled without a check of their type.", "Allow a list of types, checked by content."),
    "PTH-08": ("Files that can run may be uploaded.", "Refuse such endings, and store uploads where nothing runs."),
    "PTH-09": ("A temporary path is fixed.", "Ask the system for a private temporary folder."),
    "PTH-10": ("A temporary file has a name that can be guessed.", "Create it with mkstemp or the like."),
    "PTH-11": ("A file is read without a look at links.", "Check with lstat, or open without following links."),
    "PTH-12": ("The folder that is listed comes from the request.", "List only folders from a fixed set."),
    "PTH-13": ("A file is open to everyone.", "Give the owner what it needs, others nothing."),
    "PTH-14": ("open() takes its path from input.", "Check the path against a fixed folder before opening it."),
    "PTH-15": ("Pickled data can run code when it is loaded.", "Use JSON or another format without code."),
    "PTH-16": ("Archive entries may name paths outside the target.", "Check each entry's resolved path before writing it."),
    "PTH-17": ("A File is made from request data.", "Compare the canonical path with the base folder."),
    "SEC-01": ("An AWS access key id is part of the code.", "Revoke the key and use roles or the environment."),
    "SEC-02": ("A Google API key is part of the code.", "Revoke the key, restrict the next one, and load it at run time."),
    "SEC-03": ("A GitHub token is part of the code.", "Revoke the token and use one from the build's secrets."),
    "SEC-04": ("A Slack token is part of the code.", "Revoke the token and load the next one from a vault."),
    "SEC-05": ("A private key is part of the code.", "Replace the key pair and keep the private half in a vault."),
    "SEC-06": ("A signed token is part of the code.", "Let it expire, and issue tokens at run time."),
    "SEC-07": ("A live Stripe key is part of the code.", "Roll the key in the dashboard and load it at run time."),
    "SEC-08": ("A SendGrid key is part of the code.", "Revoke the key and load the next one at run time."),
    "SEC-09": ("A Twilio key is part of the code.", "Revoke the key and load the next one at run time."),
    "SEC-10": ("A database address contains its password.", "Keep user and password out of the address."),
    "SEC-11": ("An AWS secret key is part of the code.", "Revoke the key and use roles or the environment."),
    "SEC-12": ("A Google OAuth client id is part of the code.", "Load it from configuration, and check where its secret is."),
    "SEC-13": ("A Kakao key is part of the code.", "Issue a new key and load it at run time."),
    "SEC-14": ("A Naver key is part of the code.", "Issue a new key and load it at run time."),
    "DF001": ("The base image has no tag.", "Name a version, better a digest."),
    "DF002": ("The image runs as root.", "Switch to a user of its own."),
    "DF003": ("No user other than root is set.", "Add a USER of its own."),
    "DF004": ("The SSH port is open.", "Reach containers through the runtime instead."),
    "DF005": ("Recommended packages are installed too.", "Add --no-install-recommends."),
    "DF006": ("A script from the network runs unseen.", "Download it, check its hash, then run it."),
    "DF007": ("Files are given to numeric owners.", "Use names, so that a reader knows who owns what."),
    "DF008": ("ADD fetches from the network.", "Fetch with curl and check the hash."),
    "DF009": ("apk keeps its index in the image.", "Add --no-cache."),
    "DF010": ("Packages are updated in a step of their own.", "Join update and install in one step."),
    "DF011": ("The health check is switched off.", "Add a check that fits the service."),
    "DF012": ("There is no health check.", "Add a HEALTHCHECK."),
    "DF013": ("A secret is set in the image.", "Pass it at run time, or as a build secret."),
    "DF014": ("Files are open to everyone.", "Give the user what it needs."),
    "DF015": ("A download's protocol may be weak.", "Use https and check the hash."),
    "TF001": ("A security group lets the whole internet in.", "Name the networks that may connect."),
    "TF002": ("A bucket can be read by everyone.", "Use a private ACL and block public access."),
    "TF003": ("A database is reachable from the internet.", "Set publicly_accessible to false."),
    "TF004": ("An instance has a public address.", "Put it behind a load balancer or a gateway."),
    "TF005": ("A bucket is not encrypted at rest.", "Add server-side encryption."),
    "TF006": ("A database is not encrypted at rest.", "Set storage_encrypted to true."),
    "TF007": ("A secret stands in the configuration.", "Use a variable marked as sensitive, or a vault."),
    "TF008": ("An AWS access key stands in the configuration.", "Use a role or a profile."),
    "TF009": ("A bucket keeps no access log.", "Add logging."),
    "TF010": ("The audit trail is switched off.", "Set enable_logging to true."),
    "TF011": ("A firewall rule lets the whole internet in.", "Name the source ranges."),
    "TF012": ("A bucket mixes ACLs and policies.", "Turn uniform access on."),
    "TF013": ("A network rule accepts every source.", "Name the source prefixes."),
    "TF014": ("Plain HTTP is allowed.", "Use HTTPS and redirect to it."),
    "TF015": ("An outdated TLS version is allowed.", "Require TLS 1.2 or later."),
    "K8S001": ("A container is privileged.", "Set privileged to false and add single capabilities."),
    "K8S002": ("A container may run as root.", "Set runAsNonRoot to true."),
    "K8S003": ("The pod shares the host's network.", "Set hostNetwork to false."),
    "K8S004": ("The pod sees the host's processes.", "Set hostPID to false."),
    "K8S005": ("The pod shares the host's IPC.", "Set hostIPC to false."),
    "K8S006": ("A dangerous capability is added.", "Drop all capabilities and add harmless ones."),
    "K8S007": ("A container has no limits.", "Set limits for memory and cpu."),
    "K8S008": ("Processes may gain more rights.", "Set allowPrivilegeEscalation to false."),
    "K8S009": ("The root file system can be written.", "Set readOnlyRootFilesystem to true."),
    "K8S010": ("A volume reaches into the host.", "Use a claim, a config map or a secret."),
    "K8S011": ("An image has no tag.", "Name a version."),
    "K8S012": ("An image follows latest.", "Name a version."),
    "K8S013": ("The default namespace is used.", "Give the workload a namespace."),
    "DF-MULTISTAGE": ("One stage builds and runs.", "Build in a stage of its own and copy the result."),
    "DF-ADDCOPY": ("ADD copies a plain file.", "Use COPY."),
    "TF-PROVIDER": ("Provider versions are not pinned.", "Add required_providers with versions."),
    "TF-BACKEND": ("The s3 backend is not encrypted.", "Set encrypt to true."),
    "K8S-SA": ("The service account's token is mounted.", "Set automountServiceAccountToken to false where nothing needs it."),
    "K8S-SECRET": ("An environment variable holds a plain secret.", "Put it in a Secret and refer to it by secretKeyRef."),
    "K8S-NP": ("Nothing here limits the pod's traffic.", "Add a NetworkPolicy for what comes in and goes out."),
}
