"""Texts with planted secrets and look-alikes, for training and measuring the secret scan.

Every text is made from a template of some kind of file or prose, in which names and values are drawn. What was planted as
a secret is known by position; everything else that looks like one (digests, ids, references, placeholders, paths,
identifiers, long words) is not. Templates belong to families; whole families can be kept from training.
"""

from __future__ import annotations

import base64
import hashlib
import random
import string

Text = tuple[str, str, str, list[tuple[int, int]]]

_B62 = string.ascii_letters + string.digits
#: Plain words of several languages, of which prose is made.
_PLAIN = "the of and to in that it was for on are with as at by from this not but have after under between please check again tomorrow der die und nicht mit auf eine wurde werden nach über les des une pour dans avec sur plus los las para como este desde cuando letter meeting report answer question number kitchen evening weather journey village people morning".split()
_NOUNS = "horse battery staple river window copper garden silver monkey dragon winter summer orange coffee planet rocket tiger falcon hunter shadow purple castle mountain correct football welcome".split()
_PARTS = "user order item page cart index report export login header button client server config cache session token secret password widget layout handler service manager module session_id request".split()
_SECRET_KEYS = "password passwd db_password PASSWORD DB_PASS_WORD token auth_token TOKEN access_token api_key API_KEY apiKey secret client_secret clientSecret AWS_SECRET_ACCESS_KEY signing_key SECRET_KEY private_key senha contraseña passwort encryption_key smtp_password authToken".split()
_OTHER_KEYS = "commit sha256 checksum etag id uuid revision version build digest integrity name title path url image color order_id tracking_id cache_key_hash md5 file description".split()


def _chars(r: random.Random, n: int, of: str = _B62) -> str:
    return "".join(r.choice(of) for _ in range(n))


def _words(r: random.Random, n: int) -> str:
    return " ".join(r.choice(_PLAIN) if r.random() < 0.85 else "".join(r.choice(_NOUNS) for _ in range(r.choice((1, 2, 3)))) for _ in range(n))


def _password(r: random.Random) -> str:
    w = [r.choice(_NOUNS) for _ in range(4)]
    return r.choice((
        "".join(w), "-".join(w[:3]) + str(r.randrange(100)), w[0] + str(r.randrange(10)) + w[1], w[0].capitalize() + str(r.randrange(1000)) + r.choice("!$#&*?"), w[0].replace("o", "0").replace("e", "3").capitalize() + r.choice("&!@#") + str(r.randrange(100)) + "!",
        _chars(r, r.randrange(8, 20)), _chars(r, r.randrange(10, 24), _B62 + "!#$%&*+-=?@^_"), w[0] + r.choice("._-") + w[1] + str(r.randrange(1900, 2030)),
    ))


def _pick(r: random.Random, makers: tuple, unseen: int, kinds: str):
    """One of ``makers``, of which the last ``unseen`` are kept from training: from all of them, those seen, or those unseen."""
    return r.choice({"all": makers, "seen": makers[:-unseen], "unseen": makers[-unseen:]}[kinds])()


def _key(r: random.Random, kinds: str = "all") -> str:
    hexes = "0123456789abcdef"
    return _pick(r, (
        lambda: _chars(r, r.choice((32, 40, 48, 64)), hexes), lambda: _chars(r, r.randrange(20, 44)), lambda: base64.b64encode(r.randbytes(r.choice((24, 32, 30)))).decode(),
        lambda: _chars(r, r.randrange(20, 36), string.ascii_letters), lambda: _named(r, kinds), lambda: _chars(r, 40, hexes), lambda: _chars(r, r.randrange(200, 900)),
        lambda: base64.urlsafe_b64encode(r.randbytes(32)).decode().rstrip("="), lambda: _chars(r, 32, hexes.upper()), lambda: _chars(r, 24, string.ascii_uppercase + "234567"),
    ), 3, kinds)


def _named(r: random.Random, kinds: str = "all") -> str:
    return _pick(r, (
        lambda: r.choice(("AKIA", "ASIA")) + _chars(r, 16, string.ascii_uppercase + "234567"), lambda: r.choice(("ghp_", "gho_", "ghs_")) + _chars(r, 36), lambda: "sk_live_" + _chars(r, 24), lambda: "AIza" + _chars(r, 35, _B62 + "_-"),
        lambda: f"SG.{_chars(r, 22)}.{_chars(r, 43)}", lambda: ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (b'{"alg":"HS256","typ":"JWT"}', b'{"sub":"%d"}' % r.randrange(10**9), r.randbytes(32))),
        lambda: "glpat-" + _chars(r, 20), lambda: f"xoxb-{_chars(r, 11, string.digits)}-{_chars(r, 24)}", lambda: "npm_" + _chars(r, 36),
    ), 3, kinds)


def _block(r: random.Random) -> str:
    """A private key in a block."""
    kind = r.choice(("RSA ", "EC ", "OPENSSH ", "", "ENCRYPTED "))
    body = base64.b64encode(r.randbytes(r.randrange(90, 700))).decode()
    head = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-256-CBC,0A1B2C3D\n\n" if kind == "RSA " and r.random() < 0.3 else ""
    newline = r.choice(("\n", "\n", "\\n"))
    lines = newline.join(body[k : k + 64] for k in range(0, len(body), 64))
    return f"-----BEGIN {kind}PRIVATE KEY-----{newline}{head if newline != chr(92) + 'n' else ''}{lines}{newline}-----END {kind}PRIVATE KEY-----"


def _certificate(r: random.Random) -> str:
    """A block that isn't secret."""
    kind = r.choice(("CERTIFICATE", "PUBLIC KEY", "CERTIFICATE REQUEST"))
    body = base64.b64encode(r.randbytes(r.randrange(90, 400))).decode()
    return f"-----BEGIN {kind}-----\n" + "\n".join(body[k : k + 64] for k in range(0, len(body), 64)) + f"\n-----END {kind}-----"


def _other(r: random.Random, kinds: str = "all") -> str:
    """A value that isn't secret."""
    h = hashlib.sha256(str(r.random()).encode()).hexdigest()
    return _pick(r, (
        lambda: h[:40], lambda: h, lambda: "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:32])), lambda: "sha512-" + base64.b64encode(r.randbytes(64)).decode(), lambda: _chars(r, r.randrange(16, 22), string.digits),
        lambda: "_".join(r.choice(_PARTS) for _ in range(r.randrange(2, 5))), lambda: "-".join(r.choice(_PARTS) for _ in range(r.randrange(3, 6))), lambda: "/".join(r.choice(_PARTS) for _ in range(r.randrange(3, 6))),
        lambda: f"v{r.randrange(9)}.{r.randrange(20)}.{r.randrange(40)}-{h[:7]}", lambda: "https://cdn.example.org/" + "/".join(r.choice(_PARTS) for _ in range(3)) + f"/{h[:16]}.js",
        lambda: h[:32], lambda: "sha256:" + h, lambda: "".join(r.choice(_PARTS).capitalize() for _ in range(4)), lambda: "data:image/png;base64," + base64.b64encode(r.randbytes(60)).decode(),
    ), 4, kinds)


def _reference(r: random.Random) -> str:
    """What stands in a credential's place without being one."""
    k = r.choice(_SECRET_KEYS).upper()
    p = r.choice(_PARTS)
    return r.choice((
        f"${{{k}}}", f"${k}", "{{ " + p + " }}", f'os.environ["{k}"]', f"os.getenv('{k}')", f"process.env.{k}", f"self.{p}_{p}", f"config.get_{p}()", f"settings.{k}", f"<your-{p}-here>", "changeme", "change_me_please", f"your-{p}-goes-here", f"your_{p}_{p}",
        "xxxxxxxxxxxxxxxx", "****************", "example_" + p, "REPLACE_WITH_" + p.upper(), "required", "string", "undefined", "Optional[str]", f"get_{p}_{p}(request)", f"req.body.{p}", "placeholder", "0000000000000000", f"vault:secret/data/{p}#{p}", f"this.{p}.value", "disabled",
        f"/etc/{p}/{p}.pem", f"./{p}/{p}.key", f"https://{p}.example.com/oauth/{p}", "Enter", f"%({p})s", f"{p}_{p}_{p}", "1234567890123456", "nullable", f"[{p}]", "hidden", f"input[name={p}]", "abcdefghijklmnop", "/run/secrets/" + p, f"arn:aws:iam::{p}",
    ))


#: Family -> (path, template); @K is a credential's key, @S a secret value, @P a password, @N a named token, @R a reference, @O another key, @V another value, @B a private key, @C a certificate, @W prose.
FAMILIES: dict[str, list[tuple[str, str]]] = {
    "env": [("config/prod.env", "@O=@V\n@K=@S\n@O=@V\n"), (".env", 'export @K="@S"\nexport @O="@V"\n'), ("deploy/app.env", "@K=@P\n@K=@R\n@O=@V\n"), (".env.example", "@K=@R\n@K=@R\n@O=@V\n")],
    "json": [("config.json", '{"@K": "@S", "@O": "@V"}'), ("src/settings.json", '{\n  "@O": "@V",\n  "@K": "@P"\n}\n'), ("package-lock.json", '"@O": {\n "version": "1.2.3",\n "integrity": "@V"\n}, "@K": "@R"')],
    "python": [("src/app.py", '@K = "@S"\n@O = "@V"\n'), ("src/db.py", "connect(host, user='u', @K='@P')\n@K = @R\n"), ("src/util.py", '@O = "@V"\n@K = @R\ndef get():\n    return "@V"\n'), ("tests/test_api.py", 'assert client.get("@V").@O == "@V"\n@K = "@R"\n')],
    "prose": [("forum", "@W @K = \"@S\" @W"), ("web", "@W. Use @N as the key @W"), ("blog", "@W @V @W, @W"), ("", "@W commit @V @W"), ("mail", "@W @W @W"), ("notes", "the @K: @P @W"), ("wiki", "@W @K is @R @W @V"), ("chat", '@W @K = "@S"@W\n@W token @W')],
    "yaml": [("values.yaml", "@O: @V\n@K: @S\nport: 80\n"), ("ci.yml", "env:\n  @K: @P\n  @K: @R\n  @O: @V\n"), ("docs/guide.md", "Set `@K: @R` and @O @V\n")],
    "javascript": [("src/index.js", "const @K = '@S';\nconst @O = '@V';\n"), ("web/app.ts", "  @K: '@N',\n  @O: \"@V\",\n  @K: @R,\n"), ("web/form.html", '<input name="csrf_token" value="@R"> <a href="@V">@W</a>\n<img src="@V">')],
    "url": [("src/db.py", "postgres://admin:@S@db.internal:5432/@W\n"), ("notes", "curl https://bot:@N@git.example.com/@V\n@O @V\n"), ("a.sh", "https://hooks.slack.com/services/T0@H/B0@H/@S\nhttps://example.com/@V\n"), ("web", "see https://example.com/@V and @V")],
    "shell": [("run.sh", "mysql -u root --password @P --@O @V\n"), ("run.sh", "curl -H 'Authorization: Bearer @N' https://api.example.com/@V\n"), ("deploy.sh", "export @K=@S\necho @V\n: ${@K:=@R}\n")],
    "java": [("src/Main.java", 'private static final String @K = "@S";\nString @O = "@V";\n'), ("app.properties", "spring.@K=@P\nspring.@O=@V\nspring.@K=@R\n"), ("settings.xml", "<@K>@S</@K>\n<@O>@V</@O>\n<@K>@R</@K>\n")],
    "pem": [("deploy/id_rsa", "@B\n"), ("src/keys.json", '{"@K": "@B", "@O": "@V"}'), ("notes", "@W\n@B\n@W"), ("certs/ca.pem", "@C\n"), ("docs/tls.md", "@W\n@C\n@W @V")],
    "list": [("log.txt", "@V\n@V @O=@V\n@O: @V\n"), ("sums.txt", "@V  @W.tar.gz\n@V  @W.zip\n"), ("keys.txt", "@N\n@N\n"), ("access.log", 'GET /@V HTTP/1.1 "@O=@V" id @V\n')],
}
#: Families that measure the forest when it is trained without them.
HELD = ("yaml", "url", "java")


def held_out(template: str) -> bool:
    return template.split(":")[0] in HELD


def _render(r: random.Random, template: str, kinds: str = "all") -> tuple[str, list[tuple[int, int]]]:
    out, at, spans = [], 0, []
    while template:
        head, _, template = template.partition("@")
        kind, rest = (template[:1], template[1:]) if template[:1] in "KSPNROVWHBC" and template else ("", template)
        value = {
            "K": lambda: r.choice(_SECRET_KEYS), "S": lambda: _key(r, kinds), "P": lambda: _password(r), "N": lambda: _named(r, kinds), "R": lambda: _reference(r), "O": lambda: r.choice(_OTHER_KEYS), "V": lambda: _other(r, kinds), "B": lambda: _block(r), "C": lambda: _certificate(r), "W": lambda: _words(r, r.randrange(1, 8)),
            "H": lambda: _chars(r, 8, string.ascii_uppercase + string.digits), "": lambda: "@" if template else "",
        }[kind]()
        out.append(head)
        at += len(head)
        if kind in ("S", "P", "N", "B"):
            spans.append((at, at + len(value)))
        out.append(value)
        at += len(value)
        template = rest
    return "".join(out), spans


def texts(n: int, seed: int = 11, kinds: str = "all") -> list[Text]:
    """(text, path, template, spans of secrets): n texts, the same for each seed; ``kinds`` of values: all, seen or unseen."""
    r = random.Random(seed)
    names = [(f"{family}:{k}", path, t) for family, ts in FAMILIES.items() for k, (path, t) in enumerate(ts)]
    out = []
    for i in range(n):
        name, path, t = names[i % len(names)]
        text, spans = _render(r, t, kinds)
        out.append((text, path, name, spans))
    return out
