"""Header and body patterns of auth-log lines, and component names."""

# groups: month, day, time, host, service, pid, body
SYSLOG_HEADER = (
    r"^(\w{3})\s+(\d+)\s+(\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\w[\w/-]*)\[(\d+)\]:\s+(.+)$"
)
# groups: timestamp, host, service, pid, body
JOURNAL_HEADER = (
    r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[.\d]*[Z+\-\d:]*)\s+(\S+)\s+(\w[\w/-]*)\[(\d+)\]:\s+(.+)$"
)
MODULE = r"(?i)pam_(\w+)\.so"
USER = r"(?i)\buser[=\s](\S+)"
RHOST = r"(?i)\brhost[=\s](\S+)"
TTY = r"(?i)\btty[=\s](\S+)"
CACHE = r"cache\s*(hit|miss)"

# sign -> wordings, any of which shows it; matched against the lower-cased body
WORDINGS = {
    "started": ["pam_start()"],
    "ended": ["pam_end()"],
    "opened": ["session opened", "pam_open_session"],
    "closed": ["session closed", "pam_close_session"],
    "ok": ["pam_success", "accepted", "succeeded", "success"],
    "bad": ["pam_auth_err", "pam_acct_expired", "pam_cred_err", "pam_user_unknown", "pam_maxtries", "pam_perm_denied",
            "failed", "failure", "authentication fail", "invalid user"],
    "kerberos": ["kerberos", "krb5", "tgt", "as-req", "kinit"],
}

# in order of precedence; matched against the lower-cased body
PHASE_WORDS = [
    ("auth", r"\bauth(entication)?\b"),
    ("account", r"\baccount\b"),
    ("session", r"\bsession\b"),
    ("password", r"\bpassword\b"),
]

ALWAYS_KEPT_SERVICES = ["sshd", "login", "su", "sudo", "gdm", "lightdm", "polkit"]

MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

COMPONENTS = [
    "app", "pamconf", "libpam", "mod_env", "mod_unix_a", "mod_sss_a", "mod_ga", "mod_deny", "mod_sss_ac",
    "mod_unix_ac", "mod_nologin", "mod_access", "mod_limits", "mod_mkhome", "sssd", "sssd_nss", "krb", "ldap",
]

# (fragments of the module file name, component, component in the account phase)
MODULE_COMPONENTS = [
    (["pam_sss"], "mod_sss_a", "mod_sss_ac"),
    (["pam_unix"], "mod_unix_a", "mod_unix_ac"),
    (["pam_env"], "mod_env", "mod_env"),
    (["pam_limits"], "mod_limits", "mod_limits"),
    (["pam_mkhomedir"], "mod_mkhome", "mod_mkhome"),
    (["pam_google", "pam_ga"], "mod_ga", "mod_ga"),
    (["pam_nologin"], "mod_nologin", "mod_nologin"),
    (["pam_access"], "mod_access", "mod_access"),
    (["pam_deny"], "mod_deny", "mod_deny"),
]

# event type -> [(component, state, state when not successful)]; "*" is the event's own module
COMPONENT_RULES = {
    "pam_start": [("app", "active", "active"), ("pamconf", "active", "active"), ("libpam", "active", "active")],
    "module_call": [("*", "active", "active")],
    "module_result": [("*", "success", "failed")],
    "sssd_call": [("sssd", "active", "active")],
    "sssd_result": [("sssd", "success", "failed"), ("sssd_nss", "active", "failed")],
    "krb_call": [("krb", "active", "active")],
    "krb_result": [("krb", "success", "failed")],
    "session_open": [("mod_limits", "success", "success"), ("mod_mkhome", "success", "success")],
    "access_granted": [("app", "success", "success"), ("libpam", "success", "success")],
    "access_denied": [("libpam", "failed", "failed"), ("app", "failed", "failed")],
}
