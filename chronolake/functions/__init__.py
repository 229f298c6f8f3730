"""chronolake.functions"""
