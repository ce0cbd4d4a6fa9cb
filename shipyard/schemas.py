"""Schemas of the deployment inputs and the small fixed dimension tables.

Everything under "Fixed values" must equal the deployment agent's own constants
for results to match; they are stated plainly, in their natural order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's constants)
# ---------------------------------------------------------------------------

MESSAGE_TYPES = [
    "BOOTSTRAP",
    "INSTALLATION",
    "CHECK_DATABASE",
    "UPDATE_AGENT",
    "UPDATE_COOKBOOKS",
    "CHECK_AGENT_VERSION",
    "CHECK_COOKBOOK_VERSION",
    "DATABASE_AUDIT_INFORMATION",
]
UNKNOWN = "UNKNOWN"
# Message types whose checksum must equal the client's stored hash.
CHECKSUM_TYPES = ["BOOTSTRAP", "INSTALLATION"]
# Header text -> command code; any other text (and NULL) is UNKNOWN.
COMMANDS = {"install": "INSTALL", "download": "DOWNLOAD", "download-install": "DOWNLOAD_AND_INSTALL"}
INSTALL_COMMANDS = ["INSTALL", "DOWNLOAD_AND_INSTALL"]
DOWNLOAD_COMMANDS = ["DOWNLOAD", "DOWNLOAD_AND_INSTALL"]
PHASE_TYPES = ["CHEF", "AGENT"]
MACHINE_LINUX = "LINUX"
MACHINE_WINDOWS = "WINDOWS"
BALANCER_RECIPES = ["recipe[mv_balancer::create_jk]", "recipe[mv_balancer::create_vhost]"]
DATABASE_ACTIONS = ["download.script.com.sucesso", "install.database.atualizada"]

# Product groups: enum key -> member items. Apps named like one of the
# PRODUCTS items are replaced by the items of their group.
PRODUCT_GROUPS = [
    ("SOULMV_WI5", ["SOUL-INTEGRATED-WORKSPACE", "SOUL-INTEGRATED-SERVICES"]),
    ("SOULMV_H5", ["SOUL-PRODUCT-WORKSPACE", "SOUL-PRODUCT-FORMS"]),
    ("SOULMV_H5_REPORTS", ["SOUL-PRODUCT-REPORTS"]),
    ("SOULMV_O5", ["SOUL-PLANO-SAUDE-WORKSPACE", "SOUL-PLANO-SAUDE-FORMS"]),
    ("SOULMV_O5_REPORTS", ["SOUL-PLANO-SAUDE-REPORTS"]),
    ("CLASRISCO", ["MVSACR", "MVGESTORFLUXO", "MVPAINEL", "MVTOTEMSENHA", "MVPAINELRECEPCAO"]),
    ("PRODUCTS", ["SOULMV-O5", "SOULMV-H5", "SOULMV-WI5", "CLASRISCO"]),
]
EXPANDABLE_PRODUCTS = ["SOULMV-O5", "SOULMV-H5", "SOULMV-WI5", "CLASRISCO"]
# Product context enum key -> context text.
PRODUCT_CONTEXTS = [
    ("SOUL_PRODUCT_FORMS", "soul-product-forms"),
    ("SOUL_PRODUCT_REPORTS", "soul-product-reports"),
    ("SOUL_PRODUCT_WORKSPACE", "soul-product-workspace"),
    ("SOUL_PLANO_SAUDE_FORMS", "soul-plano-saude-forms"),
    ("SOUL_PLANO_SAUDE_REPORTS", "soul-plano-saude-reports"),
    ("SOUL_PLANO_SAUDE_WORKSPACE", "soul-plano-saude-workspace"),
    ("SOUL_INTEGRATED_WORKSPACE", "soul-mv"),
    ("SOUL_INTEGRATED_SERVICES", "soul-integrated-services"),
    ("MVSACR", "mvsacr"),
    ("MVGESTORFLUXO", "mvgestorfluxo"),
    ("MVPAINELRECEPCAO", "mvpainelrecepcao"),
    ("MVTOTEMSENHA", "mvtotemsenha"),
    ("MVPAINEL", "mvpainel"),
]
EXPANDED_TYPE = "forms"
REPORTS_TYPE = "reports"
REPORTS_SUFFIX = "_REPORTS"
REPORTS_CONTEXT = "soul-product-reports"

# Validation rules.
VALIDATION_TYPES = [
    "CHECK_AGENT_VERSION",
    "CHECK_SERVERS_DISK_SPACE",
    "CHECK_DATABASE_CONNECTION",
    "CHECK_DATABASE_TABLESPACE",
    "CHECK_DATABASE_USER_MASTER",
]
TABLESPACE_RULES = [("MV2000_D", 28672), ("MV2000_I", 28672), ("MV2000_L", 8192)]
PRIVILEGE_RULES = [("PACKAGE", "UTL_RECOMP"), ("ROLE", "DBA")]
DEFAULT_WINDOWS_DRIVE = "C:"

# Catalog statements.
GRANT_OWNERS = ["DBAMV", "DBASGU", "DBAPS", "MVINTEGRA"]
GRANT_GRANTEES_4 = ["DBAMV", "DBASGU", "DBAPS", "MVINTEGRA"]
GRANT_GRANTEES_5 = ["DBAMV", "DBASGU", "DBAPS", "MVINTEGRA", "MV2000"]
GRANT_TARGETS = [
    ("DBAMV", "DBAPS,DBASGU,MVINTEGRA,MV2000"),
    ("DBAPS", "DBAMV,DBASGU,MVINTEGRA,MV2000"),
    ("DBASGU", "DBAMV,DBAPS,MVINTEGRA,MV2000"),
    ("MVINTEGRA", "DBAMV,DBAPS,DBASGU,MV2000"),
]
VIEW_GRANT_MIN = 12
CODE_GRANT_MIN = 4
SYNONYM_TABLE_OWNER = "DBAMV"
SYNONYM_OBJECT_TYPES = ["FUNCTION", "PROCEDURE", "PACKAGE", "SEQUENCE"]
FK_OWNERS = ["DBAMV", "DBASGU"]
RECYCLE_BIN_PATTERN = "%BIN$%"
PLAN_TABLE = "PLAN_TABLE"
PUBLIC = "PUBLIC"
AUDIT_ROWS = 200
REGISTRY_OBJECT = "GCM_VERSAO"
REGISTRY_OWNER = "DBAMV"

# Statements produced from the catalog ({...} are filled in per row).
GRANT_VIEW = "GRANT SELECT,UPDATE,DELETE,INSERT ON {owner}.{name} TO {grantees}"
GRANT_SEQUENCE = "GRANT SELECT ON {owner}.{name} TO {grantees}"
GRANT_CODE = "GRANT EXECUTE ON {owner}.{name} TO {grantees}"
CREATE_SYNONYM = "CREATE PUBLIC SYNONYM {name} FOR {owner}.{name}"
CREATE_FK_INDEX = "create index {owner}.{index}\n ON {owner}.{table}({columns}) TABLESPACE MV2000_I COMPUTE STATISTICS"
FK_SUFFIX = "_FK"
IX_SUFFIX = "_IX"

# Script packages and scripts.
SCRIPT_ENTRY_PREFIX = "products/{product}/database/pre/"
SCRIPT_ENCODING = "iso-8859-1"
SCRIPT_PHASE = "pre"
STATEMENT_TERMINATOR = "/"

# Text rewrites.
PASSWORD_ARG = "-P '{password}'"
PASSWORD_MASK = "-P ***"
RUBY_HASH_REWRITES = [("=>", ":"), (":nil", ":null")]

# Rule messages ({...} are filled in per row).
MSG_TABLESPACE_MISSING = "As Tablespaces [{items}] nao foram criadas!"
MSG_TABLESPACE_WRONG = "As Tablespaces [{items}] foram criadas com tamanho errado!"
MSG_NO_PACKAGE = "Usuário logado [{user}] não tem permissão na PACKAGE {package}"
MSG_NO_ROLE = "Usuário logado [{user}] não tem permissão de DBA [{role}]"
MSG_DISK_LOW = "Servidor sem espaço em disco suficiente! Livre: {free} MB / Necessário: {metric} MB"
MSG_DISK_FAILED = "Falha ao checar espaço em disco livre do servidor {host} / Causa {cause}"
MSG_HOME_MISSING = "MV_HOME [{drive}] não encontrada nos atributos do chef!"
MSG_AGENT_OLD = "Agente desatualizado! Versão do agente atual [{current}] / Versão do agente necessária {required} "

# Events and logs.
LOG_RECIPE_START = "Executando {recipe}!"
LOG_RECIPE_OK = "{recipe} finalizado no servidor com sucesso!"
LOG_RECIPE_FAIL = "{recipe} finalizado no servidor com falha!"
LOG_DONE = "Processo concluido!"
LOG_REJECTED = "Requisitos para procedimentos no ambiente não atendidos, processo abortado!"
LOG_TYPE = "plano.execucao"
LOG_SYNC_FLAG = "S"
LOG_LEVELS = ["INFO", "WARN", "ERROR", "DEBUG"]
ERROR_DESCRIPTION_PREFIX = "Erro - "

# ---------------------------------------------------------------------------
# Input schemas (explicit, no inference)
# ---------------------------------------------------------------------------

S = T.StringType()

MESSAGE_SCHEMA = T.StructType([
    T.StructField("msg_id", S),
    T.StructField("client_id", S),
    T.StructField("environment", S),
    T.StructField("execution_plan", S),
    T.StructField("message_id", S),
    T.StructField("checksum", S),
    T.StructField("type_message", S),
    T.StructField("command", S),
    T.StructField("body", S),
    T.StructField("arrival_ts", T.TimestampType()),
])

CLIENT_SCHEMA = T.StructType([
    T.StructField("client_id", S),
    T.StructField("env_hash", S),
    T.StructField("agent_version", S),
])

APP_SCHEMA = T.StructType([T.StructField(n, S) for n in (
    "productname", "group", "context", "type", "version", "itemVersion", "port",
    "serverId", "balancer_host", "balancer_port", "serverInstance")])

SERVER_SCHEMA = T.StructType([
    T.StructField("soulmvlinux", T.StructType([T.StructField(n, S) for n in (
        "serverHost", "serverUser", "serverPassword", "serverType", "environment", "urlbase")])),
    T.StructField("tomcatinstance", T.StructType([T.StructField("port", T.ArrayType(S))])),
    T.StructField("app_list", T.ArrayType(APP_SCHEMA)),
    T.StructField("run_list", T.ArrayType(T.StructType([
        T.StructField("id", S), T.StructField("recipes", T.ArrayType(S))]))),
])

PHASE_SCHEMA = T.StructType([T.StructField(n, S) for n in (
    "id", "type", "initialProgress", "finalProgress", "statusInitial", "statusComplete",
    "statusError", "initialDescription", "finalDescription")])

INSTALLATION_SCHEMA = T.StructType([
    T.StructField("list_server", T.ArrayType(SERVER_SCHEMA)),
    T.StructField("listBalancer", T.ArrayType(T.StructType([
        T.StructField("host", S), T.StructField("port", S)]))),
    T.StructField("executionPlan", T.ArrayType(PHASE_SCHEMA)),
    T.StructField("scriptList", T.ArrayType(T.StructType([T.StructField(n, S) for n in (
        "filename", "productName", "scriptId", "version")]))),
    T.StructField("validations", T.ArrayType(T.StructType([
        T.StructField("name", S), T.StructField("metric", S)]))),
    T.StructField("databaseAuditProcess", T.StructType([
        T.StructField("nameScript", S), T.StructField("urlScript", S)])),
    T.StructField("databaseInformation", T.StructType([
        T.StructField("clientId", T.LongType()),
        T.StructField("environmentName", S),
        T.StructField("serviceName", S),
        T.StructField("jdbcHost", S),
        T.StructField("jdbcPort", T.LongType()),
        T.StructField("cdUserApp", S),
        T.StructField("cdUserInstall", S),
        T.StructField("hashEnvironment", S),
    ])),
])

# Body schema per route. The update and version checks carry no fields of interest: their
# bodies parse as a map from names to texts.
ANY_BODY = T.MapType(S, S)
BODY_SCHEMAS = {
    "INSTALLATION": INSTALLATION_SCHEMA,
    "BOOTSTRAP": T.StructType([T.StructField(n, S) for n in (
        "name", "host", "type", "userLogin", "passwordUser", "initialExecution")]),
    "CHECK_DATABASE": INSTALLATION_SCHEMA["databaseInformation"].dataType,
    "DATABASE_AUDIT_INFORMATION": INSTALLATION_SCHEMA["databaseInformation"].dataType,
    "UPDATE_AGENT": ANY_BODY,
    "UPDATE_COOKBOOKS": ANY_BODY,
    "CHECK_AGENT_VERSION": ANY_BODY,
    "CHECK_COOKBOOK_VERSION": ANY_BODY,
}

# Fields that hold secrets; they never enter a table.
SECRET_FIELDS = ["serverPassword", "passwordUser", "passwordApp", "passwordInstall"]

# Exit statuses of the recipes as they come back from the nodes (input of the
# installation flow). A step is (phase, server entry, visiting entry, run-list
# entry, recipe); database phases use -1 for the four positions.
STEP_OUTCOME_SCHEMA = T.StructType([
    T.StructField("msg_id", S),
    T.StructField("phase_id", S),
    T.StructField("srv_pos", T.IntegerType()),
    T.StructField("visit_pos", T.IntegerType()),
    T.StructField("entry_pos", T.IntegerType()),
    T.StructField("rec_pos", T.IntegerType()),
    T.StructField("exit_status", T.IntegerType()),
])
