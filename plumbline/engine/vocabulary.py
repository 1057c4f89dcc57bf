"""Names that mean something to the analysis. All lists are fixed values of the analysed framework and language."""

from __future__ import annotations

CLASSES = ("xss", "sqli", "lfi", "upload", "ssrf", "rce", "deserial", "other")
BIT = {c: 1 << i for i, c in enumerate(CLASSES)}
ALL = (1 << len(CLASSES)) - 1

SUPERGLOBALS = frozenset("_GET _POST _REQUEST _COOKIE _FILES _SERVER _ENV HTTP_RAW_POST_DATA".split())
REQUEST_SOURCES = frozenset("filter_input filter_input_array getallheaders apache_request_headers".split())
REQUEST_KEYS = frozenset("QUERY_STRING REQUEST_URI REMOTE_ADDR HTTP_HOST HTTP_USER_AGENT HTTP_REFERER CONTENT_TYPE CONTENT_LENGTH".split())
VALIDATORS = frozenset("FILTER_VALIDATE_INT FILTER_VALIDATE_FLOAT FILTER_VALIDATE_BOOLEAN FILTER_SANITIZE_NUMBER_INT FILTER_SANITIZE_NUMBER_FLOAT".split())
PERSISTENT_SOURCES = frozenset("get_option get_post_meta get_user_meta get_term_meta get_transient get_site_option get_comment_meta".split())
PERSISTENT_CLASSES = ("rce", "deserial", "lfi")
REQUEST_METHODS = frozenset("get_param get_params get_query_params get_body_params get_json_params get_body get_header".split())

XSS_SANITIZERS = frozenset("esc_html esc_attr esc_textarea esc_js esc_url esc_url_raw wp_kses wp_kses_post htmlspecialchars htmlentities strip_tags wp_strip_all_tags tag_escape sanitize_text_field sanitize_textarea_field".split())
CLASS_SANITIZERS = {"xss": XSS_SANITIZERS, "sqli": frozenset({"esc_sql", "esc_like"}), "lfi": frozenset({"basename", "sanitize_file_name"}), "upload": frozenset({"sanitize_file_name"})}
SANITIZERS = frozenset(
    "esc_html__ esc_html_e esc_attr__ esc_attr_e esc_xml wp_kses_data antispambot sanitize_email sanitize_key sanitize_title sanitize_title_with_dashes sanitize_user sanitize_html_class "
    "sanitize_hex_color sanitize_hex_color_no_hash sanitize_mime_type sanitize_option sanitize_url sanitize_sql_orderby wp_parse_id_list validate_file wp_validate_boolean absint intval floatval boolval "
    "is_numeric ctype_digit number_format zeroise addslashes mysqli_real_escape_string mysql_real_escape_string real_escape_string filter_var preg_quote rawurlencode urlencode json_encode md5 sha1 hash wp_hash wp_verify_nonce".split()
)
DECODERS = {"htmlspecialchars_decode": BIT["xss"], "html_entity_decode": BIT["xss"]}
PREDICATES = frozenset("is_array is_string is_bool is_int is_null is_object array_key_exists in_array count sizeof strlen mb_strlen gettype".split())

SINKS = {
    "rce": "system exec shell_exec passthru popen proc_open pcntl_exec eval assert call_user_func call_user_func_array array_map array_walk usort uasort uksort register_shutdown_function register_tick_function",
    "lfi": "fopen readfile file file_get_contents highlight_file show_source parse_ini_file readlink opendir scandir glob unlink locate_template load_template get_template_part virtual",
    "upload": "file_put_contents move_uploaded_file fwrite fputs copy wp_handle_sideload media_handle_sideload wp_handle_upload media_handle_upload",
    "deserial": "unserialize maybe_unserialize yaml_parse igbinary_unserialize",
    "ssrf": "header wp_remote_get wp_remote_post wp_remote_request wp_remote_head curl_exec fsockopen stream_socket_client get_headers getimagesize",
    "other": "wp_redirect wp_safe_redirect setcookie setrawcookie extract parse_str mb_parse_str import_request_variables preg_replace create_function",
    "xss": "printf vprintf print_r",
    "sqli": "mysqli_query mysql_query mysqli_multi_query mysqli_real_query pg_query sqlsrv_query mssql_query",
}
SINK_OF = {name: c for c, names in SINKS.items() for name in names.split()}
#: Sinks of which only one argument counts, by its index.
SINK_ARGUMENT = {"array_map": 0, "array_walk": 1, "call_user_func": 0, "call_user_func_array": 0, "usort": 1, "uasort": 1, "uksort": 1, "preg_replace": 0, "create_function": 1, "register_shutdown_function": 0, "register_tick_function": 0}
SQL_METHODS = frozenset("query get_results get_row get_var get_col".split())
SQL_ONLY = frozenset("get_results get_row get_var get_col".split())
SQL_HINTS = ("wpdb", "->db", "$db", "database", "mysqli", "->dbh", "$dbh", "pdo", "->conn", "dbal", "->wpdb")

STATE_CHANGES = frozenset(
    "update_option add_option delete_option update_site_option update_network_option update_post_meta add_post_meta delete_post_meta update_user_meta add_user_meta delete_user_meta update_term_meta "
    "wp_insert_post wp_update_post wp_delete_post wp_insert_user wp_create_user wp_update_user wp_set_password wp_insert_comment wp_update_comment wp_delete_comment wp_set_comment_status wp_insert_term wp_update_term "
    "wp_delete_term wp_set_object_terms wp_set_post_terms wp_insert_attachment add_role remove_role set_transient set_site_transient wp_schedule_event rename rmdir mkdir".split()
)
STATE_METHODS = frozenset("insert update delete replace".split())
WRITE_WORDS = ("INSERT ", "UPDATE ", "DELETE ", "REPLACE ")
NONCE = frozenset("wp_verify_nonce check_admin_referer check_ajax_referer".split())
BARE_NONCE = frozenset("check_admin_referer check_ajax_referer".split())
CAPABILITY = frozenset("current_user_can current_user_can_for_blog user_can author_can is_super_admin map_meta_cap".split())
EXITS = frozenset("wp_die wp_send_json wp_send_json_error wp_send_json_success wp_redirect_exit".split())
SAFE_MEMBERS = {"_FILES": frozenset("tmp_name size error".split()), "_SERVER": frozenset("REQUEST_TIME REQUEST_TIME_FLOAT SERVER_ADDR SERVER_PORT SERVER_SOFTWARE DOCUMENT_ROOT SCRIPT_FILENAME GATEWAY_INTERFACE".split())}

#: Registrations of handlers: pattern of the call, entry point, priority (the lower, the stronger).
HOOKS = (
    (r"add_action\s*\(\s*['\"]wp_ajax_nopriv_\w+['\"]", "ajax_nopriv", 1), (r"add_action\s*\(\s*['\"]wp_ajax_(?!nopriv_)\w+['\"]", "ajax_auth", 2), (r"register_rest_route\s*\(", "rest_api", 3),
    (r"add_shortcode\s*\(\s*['\"][\w-]+['\"]", "shortcode", 4), (r"add_action\s*\(\s*['\"]init['\"]", "admin", 5), (r"add_action\s*\(\s*['\"]admin_\w*['\"]", "admin", 6),
)
#: Registrars of admin pages, and permission callbacks that let everybody in.
MENUS = r"\b(add_(?:menu|submenu|options|management|theme|plugins|users|dashboard|posts|media|comments|pages)_page)\s*\("
PUBLIC = r"(?i)__return_true|^\s*['\"]?true['\"]?\W*$"
CONFIDENCE = {"output": 0.60, "include": 0.66, "call": 0.66, "persistent": 0.52, "risk": 0.45, "across": 0.72, "composition": 0.68}
