"""Fixed values of the domain: limits, patterns, word lists and messages.

All values here must be as they are for results to be right; they are stated
once, as plain text, and used by name everywhere else.
"""
from __future__ import annotations

# --- block preparation (fixed values) ---
MIN_TEXT_CHARS = 20
MIN_IMAGE_AREA = 100_000
TABLE_MIN_LINES = 3
TABLE_SHARE = 0.4

# --- chunking (fixed values) ---
MIN_CHUNK_CHARS = 80
MAX_CHUNK_CHARS = 800
OVERLAP_CHARS = 150
CUT_ZONE_CHARS = 100
HEADING_MAX_CHARS = 120
TITLE_MAX_CHARS = 150
TITLE_LOOK_BACK = 19

# Fixed patterns: headings and command-line marks.
HEADING = r"(?imd)^(?:Lab\s+\d|Step\s+\d|Figure\s+\d|Section\s+\d|Chapter\s+\d|\d+\.\d+\s+[A-Z])"
CLI_MARK = (
    r"(?iU)\[[\w\-]+\]|<[\w\-]+>|display |interface |vlan |ospf |ip route|undo |system-view|"
    r"GigabitEthernet|Eth-Trunk|Vlanif"
)

# --- caption responses (fixed values) ---
CAPTION_MARKERS = ("DESCRIPTION:", "CATÉGORIE:", "ÉLÉMENTS CLÉS:", "TERMES TECHNIQUES:", "CONFIANCE:")
CAPTION_CATEGORIES = (
    "network_topology", "architecture_diag", "performance_graph", "flow_diagram",
    "table_visual", "screenshot", "technical_schema", "unknown",
)
CAPTION_DEFAULT_CONFIDENCE = 0.8

# --- retrieval (fixed values) ---
RRF_K = 60
DENSE_WEIGHT = 0.7
SPARSE_WEIGHT = 0.3
TOP_K = 5
IMAGE_QUOTA = 3
TABLE_QUOTA = 2
FANOUT_EXTRA = 3
TEXT_TYPES = ("text", "code_cli", "heading")

# --- planning (fixed word lists, in rule order) ---
INTENT_RULES = (
    ("design_update", ("ajoute", "ajouter", "déployer", "deploy", "mettre en place", "nouveau switch",
                       "nouveau routeur", "topology.yaml", "assistant de déploiement", "design update")),
    ("health_report", ("rapport", "santé", "prédiction", "prédire", "fatigue", "vieillissement",
                       "obsolescence", "health")),
    ("diagnostic", ("pourquoi", "erreur", "problème", "down", "fail", "cannot", "not working", "issue",
                    "ne marche pas", "ne fonctionne pas", "panne")),
    ("audit", ("audit", "comparer", "compare", "conformit", "vérif", "check", "verify", "conforme")),
    ("status_check", ("état", "status", "running", "actif", "fonctionne", "up", "is it", "est-ce que")),
    ("optimization", ("optimis", "améliorer", "improve", "performance", "bottleneck", "goulot")),
    ("explanation", ("expliquer", "explain", "qu'est-ce", "what is", "comment fonctionne", "c'est quoi")),
    ("configuration", ("configurer", "configure", "how to", "comment", "setup", "créer", "mettre en place")),
    ("comparison", ("différence", "vs", "versus", "compare", "quelle est la diff")),
)
HEALTH_WORDS = ("rapport", "santé", "prédiction", "prédire", "obsolescence", "fatigué", "panne", "échéance")
PROTOCOLS = (
    "OSPF", "BGP", "RIP", "LACP", "VLAN", "STP", "RSTP", "MSTP", "LLDP", "VRP", "SNMP", "SSH", "TELNET",
    "VRRP", "DHCP", "ACL", "NAT", "QOS", "MPLS",
)
QUESTION_INTERFACE = r"(?i)(?:GigabitEthernet|GE|FastEthernet|FE|Ethernet|Vlanif|Eth-Trunk|LoopBack)\s*[\d/.]+"
SCHEMA_WORDS = ("schéma", "topologie", "diagram", "topology")
NETWORK_WORDS = ("réseau", "network", "switch", "router")
LIVE_INTENTS = ("diagnostic", "optimization", "health_report", "status_check")
CHUNK_TYPES = {
    "configuration": ("code_cli", "text", "heading"),
    "diagnostic": ("code_cli", "text", "table"),
    "audit": ("code_cli", "text", "table", "image_desc"),
    "explanation": ("text", "image_desc", "heading"),
    "optimization": ("code_cli", "text", "image_desc"),
    "health_report": ("code_cli", "text", "table"),
    "status_check": ("code_cli", "table", "text"),
    "comparison": ("code_cli", "text", "image_desc", "table"),
    "design_update": ("code_cli", "text", "table"),
    "unknown": ("code_cli", "text"),
}
# Fixed texts of the sub-queries: (intent, texts) per protocol.
#: Search texts and parsing patterns name the maker of the devices where they say {vendor}.
VENDOR = "Acme"
PROTOCOL_QUERIES = {
    "OSPF": {
        "status_check": ("{vendor} display ospf peer", "{vendor} OSPF process area configuration"),
        "configuration": ("{vendor} VRP OSPF configuration", "{vendor} OSPF area configuration"),
        "diagnostic": ("{vendor} OSPF troubleshooting", "{vendor} display ospf peer", "{vendor} OSPF neighbor state"),
        "audit": ("{vendor} OSPF best practices", "{vendor} OSPF configuration standards"),
    },
    "BGP": {
        "status_check": ("{vendor} display bgp peer", "{vendor} BGP process configuration"),
        "configuration": ("{vendor} VRP BGP configuration",),
        "diagnostic": ("{vendor} BGP troubleshooting", "{vendor} display bgp peer", "{vendor} BGP neighbor state"),
        "audit": ("{vendor} BGP security best practices",),
    },
    "VRRP": {
        "status_check": ("{vendor} display VRRP peer", "{vendor} VRRP process configuration"),
        "configuration": ("{vendor} VRP VRRP configuration",),
        "diagnostic": ("{vendor} VRRP troubleshooting", "{vendor} VRRP master backup state"),
    },
    "RSTP": {
        "status_check": ("{vendor} display RSTP peer", "{vendor} RSTP process configuration"),
        "diagnostic": ("{vendor} RSTP troubleshooting", "{vendor} spanning tree topology issue"),
        "configuration": ("{vendor} RSTP configuration",),
    },
}
VLAN_QUERIES = {
    "diagnostic": ("{vendor} VLAN troubleshooting", "{vendor} trunk VLAN configuration", "{vendor} dot1q troubleshooting"),
    "audit": ("{vendor} VLAN best practices", "{vendor} VLAN security standards"),
}
INTERFACE_QUERIES = {
    "diagnostic": ("{vendor} interface troubleshooting", "{vendor} display interface command",
                   "{vendor} interface down troubleshooting"),
    "configuration": ("{vendor} interface configuration", "{vendor} interface description configuration"),
}
CONTEXT_QUERIES = (
    ("ping", ("{vendor} ping troubleshooting", "{vendor} ICMP connectivity troubleshooting")),
    ("route", ("{vendor} routing troubleshooting", "{vendor} display ip routing-table")),
    ("arp", ("{vendor} ARP troubleshooting", "{vendor} display arp")),
    ("dhcp", ("{vendor} DHCP troubleshooting", "{vendor} DHCP configuration")),
    ("mac", ("{vendor} MAC address table troubleshooting", "{vendor} display mac-address")),
    ("latence", ("{vendor} network performance troubleshooting",)),
    ("perte", ("{vendor} packet loss troubleshooting",)),
)
INTENT_QUERIES = {
    "diagnostic": ("{vendor} VRP network troubleshooting methodology",),
    "audit": ("{vendor} configuration audit checklist", "{vendor} network best practices"),
    "optimization": ("{vendor} network performance optimization", "{vendor} configuration tuning best practices"),
    "explanation": ("{vendor} VRP architecture explanation",),
    "design_update": ("{vendor} switch trunk configuration", "{vendor} topology.yaml device definition"),
}
DEFAULT_QUERIES = ("{vendor} VRP configuration guide", "{vendor} network troubleshooting guide")
MAX_SUB_QUERIES = 6
AUDIT_QUERIES = (
    "{d} sysname hostname nom équipement",
    "{d} VLAN vlanif management VLAN 10 VLAN 20 VLAN 99",
    "{d} interface GigabitEthernet access trunk configuration",
    "{d} adresse IP configuration attendue manuel",
    "{d} sécurité SSH stelnet utilisateur",
)

# --- collection (fixed command lists) ---
SWITCH_COMMANDS = (
    "display version", "display current-configuration", "display vlan", "display interface brief",
    "display ip routing-table", "display cpu-usage", "display memory-usage", "display stp brief",
)
ROUTER_COMMANDS = (
    "display version", "display current-configuration", "display ip routing-table", "display interface brief",
    "display ospf peer", "display ip interface brief", "display cpu-usage", "display memory-usage",
)
PROTOCOL_COMMANDS = {
    "OSPF": "display ospf peer", "BGP": "display bgp peer", "VRRP": "display vrrp",
    "STP": "display stp brief", "RSTP": "display stp brief", "MSTP": "display stp brief",
    "LLDP": "display lldp neighbor brief",
}
HEAVY_COMMAND = "display cpu-usage"
EXPORT_SUFFIXES = {
    "config": "display current-configuration", "vlans": "display vlan",
    "interfaces": "display interface brief", "routing": "display ip routing-table",
    "ospf": "display ospf peer", "version": "display version",
    "cpu": "display cpu-usage", "memory": "display memory-usage",
}

# --- command output (fixed patterns) ---
PROMPT = r"[\[<][\w\-]+[\]>]"
INTERFACE_ROW = (
    r"(?i)(?<!\w)((?:Gigabit|Fast|Eth|Vlanif|GE|FE|XGE)[\w/.\-]+)\s+(up|down|\*down)\s+(up|down)"
)
VLAN_ROW = r"(?md)^(\d+)[ \t]+(common|super|sub)[ \t]*(.*)$"
ROUTE_ROW = (
    r"(?i)([\d.]+/\d+)\s+(Direct|Static|OSPF|RIP|BGP|ISIS)\s+\d+\s+\d+\s+\w+\s+([\d.]+)\s+([\w/.\-]+)"
)
OSPF_HEADER = r"(?i)interface\s+[\d.]+\(([\w/.\-]+)\)'s neighbors"
OSPF_PEER = r"(?i)Router ID:\s*([\d.]+)\s+Address:\s*([\d.]+)"
OSPF_STATE = r"(?i)State:\s*([\w\-]+)"
OSPF_BRIEF = (
    r"(?i)([\d.]+)\s+\d+\s+(Full|Init|2-Way|ExStart|Exchange|Loading|Down)[/\w]*\s+\d+\s+([\d.]+)\s+([\w/.\-]+)"
)
BGP_ROW = r"(?md)^([\d.]+)\s+\d+\s+(\d+)\s+\d+\s+\d+\s+\d+\s+([\w:]+)\s+(\w+)[ \t]*(\d*)"
VRRP_BLOCK = r"(?<!\S)(?=\S+\s*\|\s*Virtual Router)"
STP_ROW = r"(?i)^(\d+)\s+(\S+)\s+(\S+)\s+(FORWARDING|DISCARDING|LEARNING|DISCARD)\s*(\S+)?"
LLDP_ROW = r"(?md)^(\S+)\s+(\S+)\s+(\S+)\s+(\d+s)"
VERSION_FACTS = (
    ("vrp_version", r"(?id)VRP.*?Version\s+([\d.]+)"),
    ("hardware", r"(?id){vendor}\s+([\w\-]+)\s+(?:Router|Switch)"),
    ("uptime", r"(?id)uptime is\s+(.+)"),
    ("reboot_cause", r"(?id)Last reboot reason\s*:\s*(.+)"),
    ("compile_date", r"(?id)compiled at\s+(.+)"),
    ("patch_version", r"(?id)Patch Version\s*:\s*(.+)"),
)
CPU_PATTERNS = (r"(?i)CPU Usage\s*:\s*([\d.]+)%", r"(\d+)%")
MEMORY_PATTERNS = (
    r"(?i)Memory\s*(?:Using\s*Rate|Usage(?:\s*Rate)?|utilization)?\s*(?:is|:)?\s*([\d.]+)%",
    r"(?i)memory\s*(?:using\s*rate|usage|utilization)?\s*(?:is|:)?\s*([\d.]+)%",
    r"(?i)([\d.]+)%\s*(?:of)?\s*memory",
)

# --- expectations (fixed patterns and names) ---
DEVICE_ALIASES = {
    "s1-core-switch": "S1", "s1-core": "S1", "s2-core-switch": "S2", "s2-core": "S2", "r1-gw-office": "R1",
    "r1-gw": "R1", "r2-gw": "R2", "lsw1": "S1", "lsw2": "S2",
}
DEVICE_NAME = r"(?iU)\b((?:S|R|LSW|SW|GW)\d+(?:[-_][A-Z0-9]+)*)\b"
MANUAL_VLAN_BATCH = r"(?iU)\bvlan\s+batch\s+([\d\s]+)"
MANUAL_VLAN = r"(?iU)\bvlan\s*(\d{1,4})\b"
MANUAL_VLANIF = r"(?iU)\bvlanif\s*(\d{1,4})\b"
MANUAL_VLAN_LIST = r"(?iU)\bvlans?\s+([\d,\s]+(?:et\s+\d+)?)"
MANUAL_ROUTE = (
    r"(?i)ip\s+route-static\s+(\d{1,3}(?:\.\d{1,3}){3})\s+(\d{1,3}(?:\.\d{1,3}){3})\s+(\d{1,3}(?:\.\d{1,3}){3})"
)
MANUAL_INTERFACE = (
    r"(?iU)\b(GigabitEthernet|GE|FastEthernet|FE|Ethernet|Eth|Vlanif|Eth-Trunk)\s*([\d/.]+)\b"
)
INTERFACE_PREFIXES = {"ge": "GigabitEthernet", "fe": "FastEthernet", "eth": "Ethernet"}
HOST_NAME_PATTERNS = (
    r"(?iU)sysname\s+([\w\-]+)",
    r"(?iU)hostname\s+([\w\-]+)",
    r"(?iU)nommé\s*[:\-]?\s*([\w\-]+)",
    r"(?iU)named?\s*[:\-]?\s*([\w\-]+)",
    r"(?iU)nom\s+(?:doit\s+être|est)\s*[:\-]?\s*([\w\-]+)",
    r"(?iU):\s*\*\*([\w\-]+)\*\*",
    r"(?iU):\s+`([\w\-]+)`",
)
#: What every match of the pattern holds, in upper case.
HOST_NAME_MARKS = ("SYSNAME", "HOSTNAME", "NOMM", "NAME", "NOM", "**", "`")
VLAN_WINDOW = 10
ROUTE_WINDOW = 10
INTERFACE_WINDOW = 3
VLAN_MIN, VLAN_MAX = 2, 4094

# --- compliance (fixed thresholds) ---
CPU_LIMIT = 70.0
MEMORY_LIMIT = 80.0
MIN_SCORE = 0.35
GOOD_CHUNKS = 3
DEVICE_BONUS = 0.2
CRITICAL_COST = 0.1
WARNING_COST = 0.05
DISCREPANCY_COST = 0.05
HIGH_CONFIDENCE = 0.75
MEDIUM_CONFIDENCE = 0.45
CONFIG_MARKS = {
    "RIP": r"(?imd)^rip\s+(\d+)",
    "DHCP": r"(?imd)dhcp\s+enable",
    "ACL": r"(?imd)^acl\s+(?:number\s+)?(\d+)",
}

# --- summaries (fixed limits) ---
SUMMARY_INTERFACES = 15
SUMMARY_VLANS = 6
SUMMARY_ROUTES = 6
SUMMARY_STP = 10
DISPLAY_INTERFACES = 10
DISPLAY_ROUTES = 8

# --- telemetry stream (fixed limits) ---
HISTORY_SECONDS = 600
HISTORY_SAMPLES = 40
HISTORY_CAP = 20
