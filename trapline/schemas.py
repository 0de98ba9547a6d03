"""Fixed schemas of the tables the operators exchange."""

CAPTURES = (
    "capture_id BIGINT, site STRING, site_num INT, species STRING, ind BIGINT, sex STRING, "
    "day INT, trap INT, trap_id INT, recap STRING, carapace DOUBLE, mass DOUBLE"
)
SITE_INDEX = "site STRING, site_num INT"
EFFORT = "site STRING, site_num INT, max_traps INT"
TRAPS = "trap_name STRING, lat DOUBLE, lon DOUBLE, trap_id INT, site STRING, trap INT"
COVARIATES = "site_num INT, forest DOUBLE, depth DOUBLE, width_m DOUBLE"
HISTORY = (
    "species STRING, site_num INT, ind BIGINT, id_site INT, trap INT, day INT, max_traps INT, "
    "count BIGINT"
)
DRAWS = "chain INT, iteration BIGINT, parameter STRING, value DOUBLE"
LATENT = "chain INT, iteration BIGINT, site_num INT, id_site INT, z INT, s DOUBLE, sex INT"
PARAMS = (
    "chain INT, iteration BIGINT, site_num INT, day INT, alpha0 DOUBLE, alpha2 DOUBLE, "
    "sigma DOUBLE"
)
