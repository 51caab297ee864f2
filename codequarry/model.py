"""Schemas of the knowledge tables. Every table carries ord, the order in which its rows were found."""

FIELDS = "array<struct<name:string,type:string,constraints:array<string>,description:string,annotations:array<string>,tags:string,json_name:string,optional:boolean,nullable:boolean,field_number:int>>"
RELATIONSHIPS = "array<struct<type:string,target:string,field:string,via:string,description:string>>"
PARAMS = "array<struct<name:string,type:string,in:string,required:boolean>>"
METHODS = f"array<struct<name:string,params:{PARAMS},params_raw:string,returns:string,docstring:string,description:string>>"

SCHEMAS = {
    "schemas": f"repo string, path string, name string, type string, source_file string, fields {FIELDS}, relationships {RELATIONSHIPS}, raw_definition string, description string, business_context string, ord bigint",
    "apis": f"repo string, path string, method string, source_file string, handler string, params {PARAMS}, request_body string, response string, description string, ord bigint",
    "services": f"repo string, path string, name string, type string, source_file string, description string, methods {METHODS}, dependencies array<string>, data_accessed array<string>, ord bigint",
    "dependencies": "repo string, path string, name string, version string, type string, source_file string, ecosystem string, ord bigint",
    "data_flows": "repo string, source string, target string, type string, description string, source_file string, ord bigint",
    "contexts": "repo_name string, purpose string, domain string, context_markdown string, when_to_use array<string>, data_ownership array<struct<entity:string,description:string,is_source_of_truth:boolean>>, service_dependencies array<struct<service:string,reason:string>>, generated_at string, model string, file_count int, ord bigint",
    "semantic_layers": "repo_name string, business_glossary array<struct<term:string,definition:string,related_schemas:array<string>,related_apis:array<string>>>, entity_descriptions map<string,string>, field_descriptions map<string,map<string,string>>, query_recipes array<struct<question:string,steps:array<struct<action:string,service:string,purpose:string>>,answer_format:string>>, generated_at string, model string, ord bigint",
}
