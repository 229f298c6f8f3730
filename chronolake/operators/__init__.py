"""chronolake.operators"""
