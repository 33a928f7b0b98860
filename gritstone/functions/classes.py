"""Classes of strings by pattern, in three levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of levels 1 and 2 in their order. A pattern matches where it is found.
LEVEL_1 = [
    ("IPv6", r"(([a-fA-F0-9]{1,4}:){7}[a-fA-F0-9]{1,4}|([a-fA-F0-9]{1,4}:){1,7}:|([a-fA-F0-9]{1,4}:){1,6}:[a-fA-F0-9]{1,4}|([a-fA-F0-9]{1,4}:){1,5}(:[a-fA-F0-9]{1,4}){1,2}|([a-fA-F0-9]{1,4}:){1,4}(:[a-fA-F0-9]{1,4}){1,3}|([a-fA-F0-9]{1,4}:){1,3}(:[a-fA-F0-9]{1,4}){1,4}|([a-fA-F0-9]{1,4}:){1,2}(:[a-fA-F0-9]{1,4}){1,5}|[a-fA-F0-9]{1,4}:((:[a-fA-F0-9]{1,4}){1,6})|:((:[a-fA-F0-9]{1,4}){1,7}|:)|fe80:(:[a-fA-F0-9]{0,4}){0,4}%[0-9a-zA-Z]+|::(ffff(:0{1,4})?:)?((25[0-5]|(2[0-4]|1?[0-9])?[0-9])\\.){3}(25[0-5]|(2[0-4]|1?[0-9])?[0-9])|([a-fA-F0-9]{1,4}:){1,4}:((25[0-5]|(2[0-4]|1?[0-9])?[0-9])\\.){3}(25[0-5]|(2[0-4]|1?[0-9])?[0-9]))"),
    ("IPv4", r"\b(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\b"),
    ("MAC", r"([a-fA-F0-9]{2}[:-]){5}([a-fA-F0-9]{2})"),
    ("DNS", r"^(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z0-9][a-z0-9-]{0,61}[a-z0-9]$"),
    ("Mail", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,6}"),
    ("UNC", r"\\\\[a-zA-Z0-9 %._-]+\\[a-zA-Z0-9 $%._-]+"),
    ("URL", r"[a-zA-Z][a-zA-Z0-9+\-.]*://([a-zA-Z0-9\-._~%!$&'()*+,;=]+@)?([a-zA-Z0-9\-._~%]+|\[[a-fA-F0-9:.]+]|\[v[a-fA-F0-9][a-zA-Z0-9\-._~%!$&'()*+,;=:]+])(:[0-9]+)?(/[a-zA-Z0-9\-._~%!$&'()*+,;=:@]+)*/?(\?[a-zA-Z0-9\-._~%!$&'()*+,;=:@/?]*)?(#[a-zA-Z0-9\-._~%!$&'()*+,;=:@/?]*)?"),
    ("UUID", r"[a-fA-F0-9]{8}(?:-[a-fA-F0-9]{4}){3}-[a-fA-F0-9]{12}"),
    ("SID", r"S-\d-\d+-(\d+-){1,14}\d+"),
    ("BitLocker", r"[0-9]{6}?-[0-9]{6}-[0-9]{6}-[0-9]{6}-[0-9]{6}-[0-9]{6}-[0-9]{6}-[0-9]{6}"),
    ("Registry", r"(HK..|HKEY_[A-Z_]+|\\Registry)\\([a-zA-Z0-9]+\\+)+[a-zA-Z0-9]+"),
    ("Windows", r'(?:""?[a-zA-Z]:|\\+[^/:*?<>|]+\\+[^/:*?<>|]*)\\+(?:[^/:*?<>|]+\\+)*\w([^/:*?<>|])*'),
]
LEVEL_2 = [
    ("Bitcoin", r"\b[13][a-km-zA-HJ-NP-Z1-9]{25,34}\b"),
    ("Aeon", r"Wm[st]{1}[0-9a-zA-Z]{94}"),
    ("Bytecoin", r"2[0-9AB][0-9a-zA-Z]{93}"),
    ("Dashcoin", r"D[0-9a-zA-Z]{94}"),
    ("Dashcoin2", r"(7|X)[a-zA-Z0-9]{33}"),
    ("Fantomcoin", r"6[0-9a-zA-Z]{94}"),
    ("Monero", r"4[0-9AB][0-9a-zA-Z]{93}|4[0-9AB][0-9a-zA-Z]{104}"),
    ("Sumokoin", r"Sumoo[0-9a-zA-Z]{94}"),
    ("Credit Card", r"[ -]*(?:4[ -]*(?:\d[ -]*){11}(?:(?:\d[ -]*){3})?\d|5[ -]*[1-5](?:[ -]*[0-9]){14}|6[ -]*(?:0[ -]*1[ -]*1|5[ -]*\d[ -]*\d)(?:[ -]*[0-9]){12}|3[ -]*[47](?:[ -]*[0-9]){13}|3[ -]*(?:0[ -]*[0-5]|[68][ -]*[0-9])(?:[ -]*[0-9]){11}|(?:2[ -]*1[ -]*3[ -]*1|1[ -]*8[ -]*0[ -]*0|3[ -]*5(?:[ -]*[0-9]){3})(?:[ -]*[0-9]){11})[ -]*"),
]

#: Level 3: digests in hexadecimal by their length in digits; one length stands for several algorithms.
HEX_DIGESTS = {
    4: ("CRC-16", "CRC-16-CCITT", "FCS-16"),
    8: ("CRC-32", "ADLER-32", "CRC-32B", "FCS-32", "FNV-132", "Joaat", "XOR-32", "XXH32"),
    16: ("MySQL323", "Half MD5", "CRC-64", "FNV-164", "XXH64", "SipHash", "DES(Oracle)", "Cisco-PIX(hex)"),
    32: ("MD5", "MD4", "NTLM", "LM", "MD2", "RIPEMD-128", "Haval-128", "Tiger-128", "Snefru-128", "Domain Cached Credentials", "Double MD5", "Skein-256(128)", "MurmurHash3-128", "FNV-1a-128"),
    40: ("SHA-1", "RIPEMD-160", "Double SHA-1", "Haval-160", "Tiger-160", "HAS-160", "Skein-256(160)", "LinkedIn", "MySQL5 without star"),
    48: ("Haval-192", "Tiger-192", "SHA-1(Oracle)", "OSX v10.4", "XSHA"),
    56: ("SHA-224", "SHA3-224", "Haval-224", "Keccak-224", "Skein-256(224)"),
    64: ("SHA-256", "SHA3-256", "BLAKE2s-256", "BLAKE3-256", "RIPEMD-256", "Haval-256", "GOST R 34.11-94", "Streebog-256", "Keccak-256", "SM3", "Snefru-256", "Skein-256"),
    80: ("RIPEMD-320",),
    96: ("SHA-384", "SHA3-384", "BLAKE2b-384", "Keccak-384", "Skein-512(384)"),
    128: ("SHA-512", "SHA3-512", "BLAKE2b-512", "Whirlpool", "BLAKE3-512", "Keccak-512", "Streebog-512", "Salsa10", "Salsa20", "Skein-512"),
    256: ("Skein-1024(1024)",),
}
#: Level 3: stored passwords by their marks.
LEVEL_3 = [
    *[(name, rf"^[a-fA-F0-9]{{{size}}}$") for size, names in HEX_DIGESTS.items() for name in names],
    ("DES(Unix)", r"^[a-zA-Z0-9./]{13}$"),
    ("BigCrypt", r"^[a-zA-Z0-9./]{15,}$"),
    ("BSDi Crypt", r"^_[a-zA-Z0-9./]{19}$"),
    ("MD5 Crypt", r"^\$1\$[a-zA-Z0-9./]{0,8}\$[a-zA-Z0-9./]{22}$"),
    ("MD5(APR)", r"^\$apr1\$[a-zA-Z0-9./]{0,8}\$[a-zA-Z0-9./]{22}$"),
    ("Sun MD5 Crypt", r"^\$md5(,rounds=[0-9]+)?\$[a-zA-Z0-9./]+\${1,2}[a-zA-Z0-9./]{22}$"),
    ("bcrypt", r"^\$2[abxy]?\$[0-9]{2}\$[a-zA-Z0-9./]{53}$"),
    ("bcrypt(SHA-256)", r"^\$bcrypt-sha256\$"),
    ("NT Crypt", r"^\$3\$\$[a-f0-9]{32}$"),
    ("SHA-1 Crypt", r"^\$sha1\$[0-9]+\$[a-zA-Z0-9./]{0,64}\$[a-zA-Z0-9./]{28}$"),
    ("SHA-256 Crypt", r"^\$5\$(rounds=[0-9]+\$)?[a-zA-Z0-9./]{0,16}\$[a-zA-Z0-9./]{43}$"),
    ("SHA-512 Crypt", r"^\$6\$(rounds=[0-9]+\$)?[a-zA-Z0-9./]{0,16}\$[a-zA-Z0-9./]{86}$"),
    ("scrypt", r"^(\$7\$|\$scrypt\$|SCRYPT:[0-9]+:)"),
    ("yescrypt", r"^\$y\$[./a-zA-Z0-9]+\$[./a-zA-Z0-9]*\$[./a-zA-Z0-9]{43}$"),
    ("gost-yescrypt", r"^\$gy\$"),
    ("Argon2", r"^\$argon2(i|d|id)\$"),
    ("PBKDF2-SHA1", r"^\$pbkdf2\$[0-9]+\$"),
    ("PBKDF2-SHA256", r"^\$pbkdf2-sha256\$[0-9]+\$"),
    ("PBKDF2-SHA512", r"^\$pbkdf2-sha512\$[0-9]+\$"),
    ("PBKDF2(Atlassian)", r"^\{PKCS5S2\}[a-zA-Z0-9+/]{64}$"),
    ("Cisco-IOS(PBKDF2-SHA256)", r"^\$8\$[a-zA-Z0-9./]{14}\$[a-zA-Z0-9./]{43}$"),
    ("Cisco-IOS(scrypt)", r"^\$9\$[a-zA-Z0-9./]{14}\$[a-zA-Z0-9./]{43}$"),
    ("Cisco Type 7", r"^[0-9]{2}([A-F0-9]{2}){4,}$"),
    ("Juniper(JunOS)", r"^\$9\$[a-zA-Z0-9./-]{4,}$"),
    ("phpass", r"^\$[PH]\$[a-zA-Z0-9./]{31}$"),
    ("Drupal 7", r"^\$S\$[a-zA-Z0-9./]{52}$"),
    ("Joomla", r"^[a-f0-9]{32}:[a-zA-Z0-9]{16,32}$"),
    ("vBulletin", r"^[a-f0-9]{32}:.{3,5}$"),
    ("osCommerce", r"^[a-f0-9]{32}:[a-zA-Z0-9]{2}$"),
    ("PrestaShop", r"^[a-f0-9]{32}:[a-zA-Z0-9]{56}$"),
    ("MyBB", r"^[a-f0-9]{32}:[a-zA-Z0-9]{8}$"),
    ("Salted SHA-1", r"^[a-f0-9]{40}:.+$"),
    ("Salted SHA-256", r"^[a-f0-9]{64}:.+$"),
    ("Salted SHA-512", r"^[a-f0-9]{128}:.+$"),
    ("MySQL5", r"^\*[A-F0-9]{40}$"),
    ("MySQL(SHA-256 auth)", r"^\$mysql\$A\$[0-9]{3}\*"),
    ("PostgreSQL MD5", r"^md5[a-f0-9]{32}$"),
    ("PostgreSQL SCRAM", r"^SCRAM-SHA-256\$[0-9]+:"),
    ("MongoDB SCRAM", r"^\$mongodb-scram\$"),
    ("MSSQL(2000)", r"^0x0100[a-fA-F0-9]{88}$"),
    ("MSSQL(2005)", r"^0x0100[a-fA-F0-9]{48}$"),
    ("MSSQL(2012)", r"^0x0200[a-fA-F0-9]{136}$"),
    ("Oracle 11g", r"^S:[A-F0-9]{60}"),
    ("Oracle 12c", r"T:[A-F0-9]{160}"),
    ("Sybase ASE", r"^0xc007[a-f0-9]{80}$"),
    ("Django(PBKDF2)", r"^pbkdf2_sha256\$[0-9]+\$"),
    ("Django(PBKDF2-SHA1)", r"^pbkdf2_sha1\$[0-9]+\$"),
    ("Django(bcrypt)", r"^bcrypt(_sha256)?\$\$2[aby]\$"),
    ("Django(argon2)", r"^argon2\$argon2"),
    ("Django(SHA-1)", r"^sha1\$[a-zA-Z0-9]*\$[a-f0-9]{40}$"),
    ("Django(MD5)", r"^md5\$[a-zA-Z0-9]*\$[a-f0-9]{32}$"),
    ("Werkzeug(PBKDF2)", r"^pbkdf2:sha(1|256|512)(:[0-9]+)?\$"),
    ("Werkzeug(scrypt)", r"^scrypt:[0-9]+:[0-9]+:[0-9]+\$"),
    ("ASP.NET Identity", r"^AQAAAA[A-E][a-zA-Z0-9+/]{50,}={0,2}$"),
    ("LDAP MD5", r"^\{MD5\}[a-zA-Z0-9+/]{22}==$"),
    ("LDAP SMD5", r"^\{SMD5\}[a-zA-Z0-9+/]{30,}={0,2}$"),
    ("LDAP SHA", r"^\{SHA\}[a-zA-Z0-9+/]{27}=$"),
    ("SSHA", r"^\{SSHA\}[a-zA-Z0-9+/]{38,}={0,2}$"),
    ("SSHA-256", r"^\{SSHA256\}[a-zA-Z0-9+/]{42,}={0,2}$"),
    ("SSHA-512", r"^\{SSHA512\}[a-zA-Z0-9+/]{85,}={0,2}$"),
    ("LDAP Crypt", r"^\{(CRYPT|crypt)\}"),
    ("AIX(smd5)", r"^\{smd5\}[a-zA-Z0-9./$]{31}$"),
    ("AIX(ssha)", r"^\{ssha(1|256|512)\}[0-9]{2}\$"),
    ("Kerberos 5 AS-REQ", r"^\$krb5pa\$"),
    ("Kerberos 5 TGS-REP", r"^\$krb5tgs\$"),
    ("Kerberos 5 AS-REP", r"^\$krb5asrep\$"),
    ("Domain Cached Credentials 2", r"^\$DCC2\$[0-9]+#"),
    ("NetNTLM", r"^[^\\/:*?<>|]{1,20}:{1,2}[^\\/:*?<>|]{0,20}:[a-fA-F0-9]{48}:[a-fA-F0-9]{48}:[a-fA-F0-9]{16}$"),
    ("NetNTLMv2", r"^[^\\/:*?<>|]{1,20}:{1,2}[^\\/:*?<>|]{0,20}:[a-fA-F0-9]{16}:[a-fA-F0-9]{32}:[a-fA-F0-9]+$"),
    ("DPAPI master key", r"^\$DPAPImk\$"),
    ("KeePass", r"^\$keepass\$\*"),
    ("7-Zip", r"^\$7z\$[0-9]+\$"),
    ("WinZip", r"^\$zip2\$\*"),
    ("PKZIP", r"^\$pkzip2?\$"),
    ("RAR3", r"^\$RAR3\$\*"),
    ("RAR5", r"^\$rar5\$[0-9]+\$"),
    ("PDF", r"^\$pdf\$[0-9]\*"),
    ("MS Office", r"^\$office\$\*20(07|10|13)\*"),
    ("MS Office(old)", r"^\$oldoffice\$[0-9]\*"),
    ("Bitcoin wallet", r"^\$bitcoin\$[0-9]+\$"),
    ("Ethereum wallet", r"^\$ethereum\$[psw]\*"),
    ("LUKS", r"^\$luks\$[0-9]\$"),
    ("BitLocker(volume)", r"^\$bitlocker\$[0-9]\$"),
    ("FileVault 2", r"^\$fvde\$[0-9]\$"),
    ("Ansible Vault", r"^\$ANSIBLE_VAULT;"),
    ("macOS(PBKDF2-SHA512)", r"^\$ml\$[0-9]+\$"),
    ("Android PIN", r"^[a-f0-9]{40}:[a-f0-9]{16}$"),
    ("SAP CODVN H", r"^\{x-is[Ss][Hh][Aa], [0-9]+\}"),
    ("Lotus Notes 6", r"^\([a-zA-Z0-9/+]{20}\)$"),
    ("Lotus Notes 8", r"^\(H[a-zA-Z0-9/+]{49}\)$"),
    ("IPMI2 RAKP", r"^[a-f0-9]{18,}:[a-f0-9]{40}$"),
    ("SIP digest", r"^\$sip\$\*"),
    ("JWT", r"^[a-zA-Z0-9_-]{8,}\.[a-zA-Z0-9_-]{8,}\.[a-zA-Z0-9_-]{8,}$"),
    ("Fuzzy hash", r"^[0-9]+:[a-zA-Z0-9+/]+:[a-zA-Z0-9+/]+$"),
]

#: What a string must hold to match at all: a cheap test before an expensive pattern.
GUARDS = {"IPv6": ":", "Mail": "@", "UNC": "\\\\", "URL": "://", "SID": "S-", "Registry": "\\", "Windows": "\\", "MAC": None, "UUID": "-", "BitLocker": "-"}


def table(level: int) -> list[tuple[str, str]]:
    return [*(LEVEL_1 if level > 0 else []), *(LEVEL_2 if level > 1 else []), *(LEVEL_3 if level > 2 else [])]


def names(level: int = 3) -> list[str]:
    """All class names, sorted without regard to case."""
    return sorted((name for name, _ in table(level)), key=str.lower)


def classify(text: Column, level: int = 1) -> Column:
    """The names of all classes that match, in table order."""
    tests = []
    for name, pattern in table(level):
        found = F.rlike(text, F.lit(pattern))
        guard = GUARDS.get(name)
        tests.append(F.when(F.contains(text, F.lit(guard)) & found if guard else found, F.lit(name)))
    return F.filter(F.array(*tests), lambda x: x.isNotNull()) if tests else F.array().cast("array<string>")


def has_class(classes: Column, *wanted: str) -> Column:
    """Whether any class has one of the names, without regard to case."""
    return F.arrays_overlap(F.transform(classes, F.lower), F.array(*[F.lit(x.lower()) for x in wanted]))
